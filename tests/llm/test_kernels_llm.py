import base64
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from isogloss.llm import byte_bpe, jaccard_join, kmeans_tree, language_id, media, mixing, secret_scan, token_counts, webp

BASE = [
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
]
SCANNER = secret_scan.Scanner(secret_scan.compile_rules())


def brute_base(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            n = len(m[2]) if k == 0 else m.end() - m.start()
            if n >= (12, 18, 16)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


PARTS = ["token", "secret", "passwd", "password", "passw", "api_key", "APIKEY", "Api", '"', "'", " ", "=", ":", "AKIA", "A1", "Z" * 9, "0123456789abcdef", "deadbeef", "é", "ab.c-d/e", "x" * 7, "\n", "="]


@given(st.lists(st.sampled_from(PARTS), max_size=30))
@settings(deadline=None, max_examples=400)
def test_base_secrets(parts):
    text = "".join(parts)
    data = text.encode()
    found = secret_scan.code_points(data, SCANNER.scan(data))
    assert [f for f in found if f[1] < 3] == brute_base(text)


@pytest.mark.parametrize("rule", secret_scan.RULES, ids=lambda r: r.kind)
def test_each_rule_against_the_library(rule):
    rng, pattern = random.Random(1), re.compile(rule.expression.encode())
    pieces = ["ghp_", "xoxb-", "AIza", "eyJ", ".eyJ", ".", "-----BEGIN ", "RSA PRIVATE KEY-----", "PRIVATE KEY-----", "aB3_-", "A" * 20, "0a" * 9, " ", "token=", "AKIA", "\n"]
    scanner = secret_scan.Scanner(secret_scan.compile_rules([rule]))
    for _ in range(300):
        data = "".join(rng.choices(pieces, k=rng.randint(0, 14))).encode()
        expected = [m.span() for m in pattern.finditer(data)]
        found = [(s, e) for s, _, e in scanner.scan(data)]
        assert set(found) <= set(expected)
        if rule.least == 1:
            assert found == expected


def test_minimal_automaton_keeps_the_language():
    small = secret_scan.compile_rules([secret_scan.Rule("x", "ab|ac"), secret_scan.Rule("y", "(?:ab|ac)")])
    assert small.moves.shape[0] == 3  # nothing, after a, after a match; both rules agree
    with pytest.raises(ValueError, match="empty"):
        secret_scan.compile_rules([secret_scan.Rule("x", "a*")])
    with pytest.raises(ValueError, match="byte by byte"):
        secret_scan.compile_rules([secret_scan.Rule("x", "a(?:bc)?")])


def test_redaction():
    text = b"x token=abcdefghijklmnop y AKIA" + b"A" * 16 + b" z"
    assert secret_scan.redact([text, None, b"clean"], SCANNER) == [b"x [secret] y [secret] z", None, b"clean"]


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (9, 1), (11, 17)])
@pytest.mark.parametrize("kind", ["noise", "few", "two", "one"])
def test_webp_round_trips(shape, kind):
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 1 << 32, shape, dtype=np.uint64).astype(np.uint32)
    pixels = {"noise": noise, "few": noise.ravel()[rng.integers(0, min(12, noise.size), shape)], "two": np.where(noise % 2, np.uint32(7), np.uint32(0xFF00FF00)), "one": np.full(shape, 0x80FF0102, np.uint32)}[kind]
    for bits in (2, 4):
        tiles = tuple((n + (1 << bits) - 1) >> bits for n in shape)
        modes, cross = rng.integers(0, 14, tiles), rng.integers(0, 1 << 24, tiles).astype(np.uint32) | np.uint32(webp.BLACK)
        for coding in ({}, {"matches": True}, {"cache_bits": 5}, {"cache_bits": 8, "matches": True}):
            for transform in ({}, {"predictor": modes}, {"cross": cross}, {"subtract_green": True}, {"predictor": modes, "cross": cross, "subtract_green": True}, {"palette": True}):
                data = webp.encode(pixels, bits=bits, **coding, **transform)
                assert (webp.decode(data) == pixels).all()


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    # Each mode alone, on a picture with slopes so that clamping happens.
    y, x = np.mgrid[:6, :6]
    pixels = ((x * 40 + y * 50) % 256 * 0x010101 + (255 - x * 9 << 24)).astype(np.uint32)
    data = webp.encode(pixels, predictor=np.full((2, 2), mode), bits=2)
    assert (webp.decode(data) == pixels).all()


def test_webp_known_bits():
    # Written by hand from the public format: a 1 x 1 image with simple codes of one symbol each.
    bits, at = 0, 0

    def put(v, n):
        nonlocal bits, at
        bits |= v << at
        at += n

    for v, n in ((0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        put(v, n)
    for symbol in (200, 17, 34, 128, 0):  # green, red, blue, alpha, distance
        put(1, 1)
        put(0, 1)
        put(int(symbol > 1), 1)
        put(symbol, 8 if symbol > 1 else 1)
    body = b"\x2f" + bits.to_bytes((at + 7) // 8, "little")
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    data = b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk
    assert webp.decode(data).tolist() == [[0x8011C822]]
    with pytest.raises(webp.WebPError):
        webp.decode(data[:22])
    with pytest.raises(webp.WebPError):
        webp.decode(b"nothing")


@given(st.binary(max_size=4000))
@settings(deadline=None, max_examples=60)
def test_media_payloads(text):
    data = media.payload(text)
    assert len(data) % media.ROW == 0 and data.startswith(text) and set(data[len(text) :]) <= {255} and data
    assert media.load(media.store(data)).tobytes() == data


@pytest.mark.parametrize(
    ("made", "kinds"),
    [
        (lambda rng: b"", "palette"),
        (lambda rng: bytes(rng.choices(b"abcdefgh", k=5000)), "palette"),
        (lambda rng: bytes(rng.choices(range(40, 90), k=2000)) * 3, "copies"),
        (lambda rng: bytes((i // 576 * 3 + j) % 251 for i in range(0, 576 * 60, 576) for j in rng.choices(range(200), k=576)), ""),
        (lambda rng: np.cumsum([rng.randint(0, 4) for _ in range(576 * 30)]).astype(np.uint8).tobytes(), "predictor"),
        (lambda rng: rng.randbytes(20_000), ""),
        (lambda rng: ("Some words and é, again and again. " * 900).encode(), "copies"),
    ],
)
def test_media_elements(made, kinds, monkeypatch):
    """Each payload comes back through the elements that its stored form should have, and is stored the same again."""
    data, seen = media.payload(made(random.Random(3))), set()
    for name, what in (("_unpack", "palette"), ("_predicted", "predictor"), ("_distance", "copies")):
        monkeypatch.setattr(webp, name, lambda *a, f=getattr(webp, name), w=what: (seen.add(w), f(*a))[1])
    stored = media.store(data)
    seen.clear()
    assert media.load(stored).tobytes() == data and stored == media.store(data)
    assert set(kinds.split()) <= seen
    assert len(stored) <= len(data) * 1.02 + 600


@pytest.mark.parametrize("mode", [1, 2])
def test_uniform_predictors_are_running_sums(mode):
    rng = np.random.default_rng(mode)
    pixels = rng.integers(0, 1 << 32, (7, 9), dtype=np.uint64).astype(np.uint32)
    one, slow = np.full((1, 1), mode), np.full((1, 1), mode)
    fast = webp._predicted(pixels, one, 9, False)
    mixed = np.array([[mode, 3]])  # tiles that aren't uniform take the way pixel by pixel; the second has no pixel
    assert (fast == webp._predicted(pixels, mixed, 4, False)).all()
    assert (webp._predicted(fast, slow, 9, True) == pixels).all() and (webp._predicted(fast, mixed, 4, True) == pixels).all()


def test_public_images():
    """Images by another encoder, which browsers are tested with."""
    for text, pixels in (
        ("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", [[0]]),
        ("UklGRi4AAABXRUJQVlA4TCEAAAAvAUAAEB8wAiMwAgSSNtse/cXjxyCCmrYNWPwmHRH9jwMA", [[0x86020202, 0x89020202], [0x83020202, 0x87020202]]),
    ):
        assert webp.decode(base64.b64decode(text)).tolist() == pixels


def test_media_of_large_payloads():
    data = media.payload(random.Random(2).randbytes(media.ROW * media.ROWS + 5))
    assert len(media.images(media.store(data))) == 2
    assert media.load(media.store(data)).tobytes() == data


ENC = byte_bpe.encoding(byte_bpe.read_ranks())


@given(st.lists(st.sampled_from(["a", "Hello", " ", "  ", "\n", "\n\n", "'s", "é", "12", "!?", "日本", "\t", "　"]), max_size=60), st.integers(1, 9))
@settings(deadline=None, max_examples=300)
def test_bpe_cuts_are_safe(parts, size):
    text = "".join(parts)
    assert "".join(p for p, _ in byte_bpe.pieces(text, size)) == text
    ids = byte_bpe.encode(text, ENC, size)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENC._mergeable_ranks, special_tokens={})
    assert ids == plain.encode_ordinary(text)
    assert ENC.decode_bytes(ids) == text.encode()


@pytest.mark.parametrize("code", [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
def test_bpe_cuts_are_safe_before_odd_spaces(code):
    for sign in ("!", "a", "1", "!\x1c", "\x1f"):
        text = f"{sign}{chr(code)}!! {sign}{chr(code)}{chr(code)}\x1d?a " * 3
        plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENC._mergeable_ranks, special_tokens={})
        for size in range(1, 8):
            assert "".join(p for p, _ in byte_bpe.pieces(text, size)) == text
            assert byte_bpe.encode(text, ENC, size) == plain.encode_ordinary(text)
    # A match of signs goes on past U+001C.
    assert list(byte_bpe.pieces("!!!!\x1c!!!!", 2)) == [("!!!!\x1c!!!!", False)]


@pytest.mark.parametrize("space", [" ", "\n", " \n\u3000"])
@pytest.mark.parametrize("after", ["", "x", "!", "1", "\x1c"])
def test_bpe_of_long_white_space(space, after):
    """Over a million white-space characters are more than the engine can match in one go."""
    run = space * (3_000_000 // len(space))
    ids = byte_bpe.encode("a" + run + after, ENC)
    assert ENC.decode_bytes(ids) == ("a" + run + after).encode()
    # The match of a run is encoded as one piece; runs that the engine can match tell how.
    short = space * (200_000 // len(space))
    assert byte_bpe.encode("a" + short + after, ENC) == ENC.encode_ordinary("a" + short + after)


def test_bpe_of_a_long_text_without_white_space():
    text = "ab1!" * 100_000
    assert byte_bpe.encode(text, ENC) == ENC.encode_ordinary(text)


def brute_tokens(word, v):
    word = word.replace(" ", "▁")
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + v.scores[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in v.scores]
        options.append((best[end - 1][0] + v.unknown, -(best[end - 1][1] + len(word[end - 1].encode()))))
        top = max(options)
        best[end] = (top[0], -top[1])
    return best[len(word)][1]


def test_token_counts_against_each_word_alone():
    v = token_counts.read_vocabulary()
    rng, words = random.Random(4), ["the", "ing", "é", "ß", "日", "x", "and", "tion", "12", "☃", "a" * 80]
    for nodes in (5, token_counts.NODES):
        trie = token_counts.Trie(v, nodes)
        for _ in range(400):
            word = rng.choice(["", " "]) + "".join(rng.choices(words, k=rng.randint(1, 4)))
            assert trie.tokens(word) == brute_tokens(word, v)
    assert "".join(token_counts.pre_tokens(" a  b\n\nc ")) == " a  b\n\nc "


def brute_sets(text, n):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@given(st.lists(st.text(alphabet="abAB é\t\n　.", max_size=40), max_size=6), st.integers(1, 4))
@settings(deadline=None, max_examples=200)
def test_shingle_sets(texts, n):
    data = [t.encode() for t in texts]
    for sets in ([jaccard_join.shingle_set(jaccard_join.word_hashes(t), n) for t in data], jaccard_join.exact_sets(data, n)):
        for a, x in zip(texts, sets, strict=True):
            assert len(x) == len(brute_sets(a, n))
            for b, y in zip(texts, sets, strict=True):
                assert len(np.intersect1d(x, y)) == len(brute_sets(a, n) & brute_sets(b, n))


def test_shingles_of_a_text_beyond_a_chunk(monkeypatch):
    text = b"one two three four five six " * 50
    expected, digest = jaccard_join.word_hashes(text), jaccard_join._text_digest(text, 1)
    monkeypatch.setattr(jaccard_join, "CHUNK", 64)
    assert (jaccard_join.word_hashes(text) == expected).all() and not len(jaccard_join.word_hashes(None))
    assert jaccard_join._text_digest(text, 1) == digest == jaccard_join._text_digest(text.upper() + b"\n", 2)


def test_words_that_polynomial_hashes_confuse():
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    x, y = jaccard_join.word_hashes(f"{a} {b}".encode())
    assert x != y


@pytest.mark.parametrize("part", [80, 90])
@pytest.mark.parametrize("frequent", [False, True])
@pytest.mark.parametrize("near", [0, 2, None])
def test_linked_sets_share_a_signature(part, near, frequent):
    """The pigeonhole: every pair over the threshold, of any sizes, meets in a bucket where one of them asks."""
    rng = np.random.default_rng(part)
    t = jaccard_join.Threshold(part, 100)
    bands = t.bands(400)
    ranges = list(zip(bands, bands[1:], strict=False))
    k = [min(near, t.differences(t.smallest(a) + a) + 1) if near is not None else jaccard_join.allocate(10**6, t, a, b) for a, b in ranges]
    common = np.unique(rng.integers(0, 1 << 63, 60 * frequent).astype(np.uint64))
    scheme = jaccard_join.Scheme(t, tuple(bands), tuple(k), common)
    seen = 0
    for _ in range(1500):
        n = int(rng.integers(1, 300))
        base = rng.integers(0, 1 << 63, n + 80).astype(np.uint64)
        some = rng.integers(0, 1 + min(n, len(common)))
        base[rng.choice(n, some, replace=False)] = common[:some]
        drop, add = rng.integers(0, max(1, n // 8) + 1, 2)
        x, y = np.unique(base[:n]), np.unique(np.concatenate([base[drop:n], base[n : n + add]]))
        if not t.link(x, y):
            continue
        (sx, wx), (sy, wy) = ({}, {}), ({}, {})
        for s, (sigs, kinds) in ((x, (sx, wx)), (y, (sy, wy))):
            for sig, kind in zip(*scheme.signatures(s), strict=True):
                sigs.setdefault(int(sig), set()).add(int(kind))
        asks, subset, close = jaccard_join.ASKS, jaccard_join.SUBSET, jaccard_join.NEAR
        met = [sig for sig in sx.keys() & sy.keys() if any(asks in pair or (subset in pair and max(pair) <= close) for pair in ((p, q) for p in sx[sig] for q in sy[sig]))]
        assert met, (len(x), len(y))
        seen += 1
    assert seen > 500


def test_neighbourhoods_grow_with_the_number_of_sets():
    t = jaccard_join.Threshold(80, 100)
    few, many = (jaccard_join.allocate(n, t, 200, 250) for n in (10, 10**10))
    assert few < many <= t.differences(160 + 200) + 1


def test_hot_signatures_are_collapsed(monkeypatch):
    monkeypatch.setattr(jaccard_join, "LOCAL_ROWS", 3)
    kind = lambda k, n: (k << 60) | n
    rows = [(1, kind(1, n)) for n in range(9, 2, -1)] + [(2, kind(1, 5)), (2, kind(3, 6))] + [(3, kind(4, n)) for n in range(9)] + [(4, kind(0, 8)), *((4, kind(4, n)) for n in range(5))]
    sig, node, hub = jaccard_join.collapse(*(np.array(c) for c in zip(*rows, strict=True)))
    assert sorted(zip(sig.tolist(), node.tolist(), strict=True)) == sorted(rows)
    assert {(s, n): h for s, n, h in zip(sig.tolist(), node.tolist(), hub.tolist(), strict=True) if h} == {(1, kind(1, n)): kind(1, 3) for n in range(4, 10)}


@given(st.integers(1, 300), st.integers(0, 40), st.integers(0, 40), st.integers(0, 10**6))
@settings(deadline=None, max_examples=150)
def test_sketches_differ_no_more_than_sets(n, drop, add, seed):
    base = np.random.default_rng(seed).integers(0, 1 << 63, n + 40).astype(np.uint64)
    x, y = np.unique(base[:n]), np.unique(base[min(drop, n - 1) : n + add])
    a, b = jaccard_join.sketch(x), jaccard_join.sketch(y)
    m = min(len(a), len(b))
    assert len(a) <= n < 2 * len(a)
    assert (jaccard_join.folded(a, m) != jaccard_join.folded(b, m)).sum() <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("blocks", [1, 2])
def test_near_sketches_connect_what_may_link(blocks):
    rng = np.random.default_rng(5)
    t = jaccard_join.Threshold(80, 100)
    base = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (9, 40, 60, 130)]
    sets = sorted((np.unique(np.concatenate([np.delete(b, rng.integers(0, len(b), 3)), rng.integers(0, 1 << 62, rng.integers(0, 6)).astype(np.uint64)])) for b in base for _ in range(12)), key=len)
    inside, block = rng.integers(0, 30, 48), np.arange(48) % blocks
    found = jaccard_join.near_of([jaccard_join.sketch(s) for s in sets], np.array([len(s) for s in sets]), inside, block, t)
    joined = jaccard_join._Joined(48)
    assert all(joined.join(a, b) for a, b in found)
    for b in range(48):
        for a in range(b):
            if t.link(sets[a], sets[b]) and inside[a] != inside[b] and (blocks == 1 or block[a] != block[b]):
                assert joined.root(a) == joined.root(b)
    assert len({joined.root(i) for i in range(48)}) >= 4


def test_a_partition_without_rows_has_no_near_sketches():
    t = jaccard_join.Threshold(90, 100)
    none = pa.RecordBatch.from_arrays([*(pa.array([], pa.int64()) for _ in range(8)), pa.array([], pa.binary())], [*"abcdefgh", "sketch"])
    for batches in ([], [none]):
        assert sum(b.num_rows for b in jaccard_join._near_rows(t)(iter(batches))) == 0
    assert jaccard_join.near_of([], *(np.zeros(0, np.int64) for _ in range(3)), t) == []


def test_links_in_a_group_join_its_components():
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 60, 3)), rng.integers(0, 1 << 62, 2).astype(np.uint64)])) for _ in range(30)]
    t = jaccard_join.Threshold(90, 100)
    true = [(a, b) for b in range(30) for a in range(b) if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 90 * (len(sets[a]) + len(sets[b]) - n)]

    def components(pairs):
        label = list(range(30))
        for a, b in pairs:
            label = [label[a] if v == label[b] else v for v in label]
        return len(set(label)), [frozenset(i for i in range(30) if label[i] == v) for v in sorted(set(label), key=label.index)]

    linked = lambda a, b: t.link(sets[a], sets[b])
    found = jaccard_join.links_of(sets, list(range(30)), np.zeros(30, int), t, linked)
    assert set(found) <= set(true) and set(components(found)[1]) == set(components(true)[1])
    across = jaccard_join.links_of(sets, list(range(30)), np.arange(30) % 2, t, linked)
    assert all((a + b) % 2 for a, b in across)


def test_tree_finds_all_with_all_leaves():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    tree = kmeans_tree.fit_tree(x, 20, 5, recall=0.9)
    assert tree.leaves > 10 and tree.sample_recall >= 0.9
    assert sorted(tree.order(x[0], tree.leaves)) == list(range(tree.leaves))
    assert len(tree.order(x[0], 3)) == 3
    assert set(tree.assign(x)) <= set(range(tree.leaves))
    same = kmeans_tree.fit_tree(np.ones((50, 3)), 5, 3)
    assert same.leaves >= 1 and (same.assign(np.ones((2, 3))) >= 0).all()


def test_language_families():
    rng = random.Random(1)
    alphabet = {"en": ["the", "and", "tion", "wh"], "de": ["und", "sch", "ung", "ü"], "fr": ["eau", "le", "é", "que"], "xx": ["zz", "qq", "kk"]}
    texts, names = [], []
    for _ in range(160):
        lang = rng.choice(sorted(alphabet))
        texts.append(" ".join("".join(rng.choices(alphabet[lang], k=3)) for _ in range(20)).encode())
        names.append(lang)
    model = language_id.fit(language_id.features(texts[:120]), names[:120])
    assert set(model.families) == {"germanic", "romance", "xx"}
    assert {tuple(model.languages[i] for i in p) for p in model.pairs} == {("en", "de")}
    got, scores = model.predict([*texts[120:], None, b"", b"12 .. !"])
    assert sum(a == b for a, b in zip(got, names[120:], strict=False)) >= 39
    assert got[-3:] == ["und"] * 3 and all(0 <= s <= 1 for s in scores)


def test_mix_classifier_learns_words():
    rng = random.Random(2)
    texts = [(" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=20)) + (" bad" if k % 3 == 0 else "")).encode() for k in range(300)]
    names = ["toxic" if k % 3 == 0 else "quality1" for k in range(300)]
    parts = [mixing.word_ids(t) for t in texts]
    c = mixing.fit_classifier([i for i, _ in parts], np.array([mixing.style(t, len(i), n) for t, (i, n) in zip(texts, parts, strict=True)]), names)
    p, tokens = c.posteriors([b"alpha beta bad", b"alpha beta gamma", None])
    assert p[0, c.domains.index("toxic")] > 0.9 > 0.1 > p[1, c.domains.index("toxic")]
    assert tokens == [3, 3, 0] and p.sum(1) == pytest.approx(1)
