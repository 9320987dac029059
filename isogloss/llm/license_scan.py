"""License scans (operator 12), in DataFrame functions only: ordered signature rules over a text's words.

Each rule is an expression over words (license_rules), with a level and keywords that its matches hold. The words of
a text that are some rule's keywords are found once; only rules that have a keyword of each of their groups among them
are tried.
Of what they find, a detection goes where one of the same or a more telling level covers its words (of two with the
same words and level, the one by the later rule). Detections that overlap otherwise both stay.

A row is judged by itself: nothing is shuffled, exploded or collected.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import SURE, Rule, rules

#: Fixed value: what a word is, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands before the first word of a match; no word holds it.
MARK = "\x01"
#: Detections that are gone through together, so that lists that grow are short.
CHUNK = 256


def pattern(expression: str) -> str:
    """The expression for texts in which each word has a space on either side; group 1 is what follows the first."""
    return f" ({expression.replace(' ', '  ')} )"


def _table(kinds: Sequence[Rule]) -> Column:
    """The rules as one literal."""
    rows = [{"level": r.level, "rule": i, "label": r.label, "base": r.base, "words": [list(g) for g in r.words], "pattern": pattern(r.expression)} for i, r in enumerate(kinds)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<level:int,rule:int,label:string,base:boolean,words:array<array<string>>,pattern:string>>")


def _matches(text: Column, rule: Column) -> Column:
    """A rule's matches from left to right, as detections."""
    marked = F.split(F.trim(F.regexp_replace(text, rule["pattern"], F.lit(f" {MARK}$1"))), "  ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith(MARK), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    hits = F.regexp_extract_all(text, rule["pattern"], F.lit(1))

    def detection(start: Column, hit: Column) -> Column:
        end = start + F.size(F.split(F.rtrim(hit), "  "))
        return F.struct(start.alias("start"), (-end).alias("minus_end"), rule["level"].alias("level"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["base"].alias("base"))

    return F.zip_with(starts, hits, detection)


_DETECTION = "struct<start:int,minus_end:int,level:int,rule:int,label:string,base:boolean>"


def _kept(ordered: Column, levels: int) -> Column:
    """Of detections by (start, larger end, level, rule) those that no earlier one covers."""
    none = F.array().cast(f"array<{_DETECTION}>")

    def step(state: Column, d: Column) -> Column:
        # ends: for each level the largest end so far of detections of that level or a more telling one.
        end = -d["minus_end"]
        ends = F.transform(state["ends"], lambda e, level: F.when((level >= d["level"]) & (end > e), end).otherwise(e))
        covered = F.get(state["ends"], d["level"]) >= end
        return F.struct(ends.alias("ends"), F.when(covered, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).alias("kept"))

    def chunk(state: Column, first: Column) -> Column:
        part = F.aggregate(F.slice(ordered, first, CHUNK), F.struct(state["ends"].alias("ends"), none.alias("kept")), step)
        return F.get(F.transform(F.array(part), lambda p: F.struct(p["ends"].alias("ends"), F.concat(state["kept"], F.array(p["kept"])).alias("kept"))), F.lit(0))

    start = F.struct(F.array(*[F.lit(0)] * levels).alias("ends"), F.array().cast(f"array<array<{_DETECTION}>>").alias("kept"))
    chunks = F.sequence(F.lit(1), F.size(ordered), F.lit(CHUNK))
    return F.when(F.size(ordered) == 0, none).otherwise(F.flatten(F.aggregate(chunks, start, chunk)["kept"]))


def scan_licenses(docs: DataFrame, kinds: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (all matches of the rules that are always reported, also where others cover them) and
    found (the detections that stay), both as array<struct<label, start, end, level>> in order of start, counted in words
    from 0 with end exclusive, one row per row of docs.

    Words are WORD of the text with A-Z lower-cased. A rule's matches don't overlap, the leftmost first. A null or empty
    text has no words; a null id stays null; repeated rows fare alike; an empty table gives an empty result; other
    columns are not read.
    """
    kinds = rules() if kinds is None else kinds
    keywords = sorted({w for r in kinds for g in r.words for w in g})
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", F.array_intersect("words", F.array(*[F.lit(w) for w in keywords])).alias("keys"))
    spaced = F.when(F.size("keys") > 0, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).otherwise(F.lit(""))
    rows = rows.select("doc_id", "n_words", "keys", spaced.alias("spaced"))
    tried = F.filter(_table(kinds), lambda r: F.forall(r["words"], lambda g: F.arrays_overlap(F.col("keys"), g)) & F.call_function("regexp_like", F.col("spaced"), r["pattern"]))
    rows = rows.select("doc_id", "n_words", "spaced", F.when(F.size("keys") > 0, tried).otherwise(F.slice(_table(kinds), 1, 0)).alias("tried"))
    ordered = F.array_sort(F.flatten(F.transform("tried", lambda r: _matches(F.col("spaced"), r))))
    rows = rows.select("doc_id", "n_words", ordered.alias("ordered"))

    def told(some: Column) -> Column:
        return F.transform(some, lambda d: F.struct(d["label"].alias("label"), d["start"].cast("long").alias("start"), (-d["minus_end"]).cast("long").alias("end"), d["level"].alias("level")))

    return rows.select("doc_id", "n_words", told(F.filter("ordered", lambda d: d["base"])).alias("base"), told(_kept(F.col("ordered"), len(SURE))).alias("found"))


def sureness(found: Column) -> Column:
    """How sure the surest detection is; 0 without any."""
    return F.coalesce(F.array_max(F.transform(found, lambda d: F.get(F.array(*[F.lit(s) for s in SURE]), d["level"]))), F.lit(0.0))
