"""Dimension tables: localities, the keys that recordings name them by, models and linkage methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Localities (place, province, and a Frisian name where there is one), by code point: the key that
# recordings name them by, the locality, whether distance matrices have it, and whether the evaluation keeps it.
LOCALITIES = (
    ("AALTEN", "Aalten Gl", True, True),
    ("ABBEKERK", "Abbekerk NH", True, True),
    ("ALMKERK", "Almkerk NB", False, False),
    ("AMERSFOORT", "Amersfoort Ut", False, False),
    ("ANGERLO", "Angerlo Gl", True, True),
    ("APELDOORN", "Apeldoorn Gl", False, False),
    ("ARUM", "Arum Fr", True, True),
    ("AUSTERLITZ", "Austerlitz Ut", True, True),
    ("AXEL", "Axel Ze", False, False),
    ("BELLINGWOLDE", "Bellingwolde Gn", True, True),
    ("BENSCHOP", "Benschop Ut", True, True),
    ("BLESKENSGRAAF", "Bleskensgraaf ZH", True, True),
    ("BOEKEL", "Boekel NB", True, True),
    ("BREDA", "Breda NB", True, True),
    ("DEN-BRIEL", "Brielle ZH", True, False),
    ("BRUNSSUM", "Brunssum Lb", True, True),
    ("DELDEN", "Delden Ov", True, True),
    ("DEVENTER", "Deventer Ov", True, True),
    ("DIEMEN", "Diemen NH", True, True),
    ("DWINGELO", "Dwingelo Dr", True, True),
    ("ECHT", "Echt Lb", True, True),
    ("EDAM", "Edam NH", True, True),
    ("EEKSTERVEEN", "Eeksterveen Dr", True, True),
    ("EELDE", "Eelde Dr", True, True),
    ("EIBERGEN", "Eibergen Gl", True, True),
    ("EISDEN", "Eijsden Lb", True, True),
    ("EINDHOVEN", "Eindhoven NB", True, True),
    ("ELBURG", "Elburg Gl", True, True),
    ("FINSTERWOLDE", "Finsterwolde Gn", True, True),
    ("FORMEARUM", "Formerum Fr - Formearum Fr", True, True),
    ("GELDROP", "Geldrop NB", False, False),
    ("GOES", "Goes Ze", False, False),
    ("GOUDA", "Gouda ZH", False, False),
    ("GRIJPSKERK", "Grijpskerk Gn", True, True),
    ("GROENEKAN", "Groenekan Ut", True, True),
    ("GROUW", "Grouw Fr - Grou Fr", True, True),
    ("HAAMSTEDE", "Haamstede Ze", True, True),
    ("HEEREWAARDEN", "Heerewaarden Gl", False, False),
    ("HEINKENSZAND", "Heinkenszand Ze", True, True),
    ("HETEREN", "Heteren Gl", False, False),
    ("HOENDERLO", "Hoenderlo Gl", True, True),
    ("HUNSEL", "Hunsel Lb", True, True),
    ("IJMUIDEN", "IJmuiden NH", True, True),
    ("INGEN", "Ingen Gl", True, True),
    ("JOURE", "Joure Fr - De Jouwer Fr", True, True),
    ("JUTFAAS", "Jutfaas Ut", True, True),
    ("KAMPEN", "Kampen Ov", True, True),
    ("KERKRADE", "Kerkrade Lb", True, True),
    ("KOEKANGE", "Koekange Dr", True, True),
    ("KOEVORDEN", "Koevorden Dr", True, True),
    ("KOEWACHT", "Koewacht Ze", True, True),
    ("LAREN", "Laren NH", True, True),
    ("LEERMENS", "Leermens Gn", True, True),
    ("LEEUWARDEN", "Leeuwarden Fr - Ljouwert Fr", True, True),
    ("LOENEN-UTRECHT", "Loenen Ut", True, True),
    ("MAASTRICHT", "Maastricht Lb", True, True),
    ("MAKKUM", "Makkum Fr", True, True),
    ("MARKEN", "Marken NH", True, True),
    ("MARUM", "Marum Gn", True, True),
    ("MEIJE", "Meije ZH", True, True),
    ("MEPPEL", "Meppel Dr", True, True),
    ("MIDDELBURG", "Middelburg Ze", True, True),
    ("MONNICKENDAM", "Monnickendam NH", True, True),
    ("NIJEHOLTPADE", "Nijeholtpade Fr", True, True),
    ("NIJVERDAL", "Nijverdal Ov", True, True),
    ("NUNSPEET", "Nunspeet Gl", True, True),
    ("OLDENZAAL", "Oldenzaal Ov", True, True),
    ("OOSTERLAND", "Oosterland Ze", False, False),
    ("OOTMARSUM", "Ootmarsum Ov", True, True),
    ("OSPEL", "Ospel Lb", False, False),
    ("OUDDORP", "Ouddorp ZH", True, True),
    ("OUDEWATER", "Oudewater Ut", True, True),
    ("PIERSHIL", "Piershil ZH", True, True),
    ("POSTERHOLT", "Posterholt Lb", True, True),
    ("PUTTEN", "Putten Gl", True, True),
    ("PUTTERSHOEK", "Puttershoek ZH", False, False),
    ("RAALTE", "Raalte Ov", True, True),
    ("REUSEL", "Reusel NB", True, True),
    ("REUVER", "Reuver Lb", True, True),
    ("RHENEN", "Rhenen Ut", True, True),
    ("RIJKEVOORT", "Rijkevoort NB", True, True),
    ("RILLAND", "Rilland Ze", True, True),
    ("RODERWOLDE", "Roderwolde Dr", True, True),
    ("ROERMOND", "Roermond Lb", False, False),
    ("ROODESCHOOL", "Roodeschool Gn", True, True),
    ("ROSWINKEL", "Roswinkel Dr", True, True),
    ("ROZENDAAL", "Rozendaal Gl", True, True),
    ("RUINEN", "Ruinen Dr", True, True),
    ("SCHEEMDA", "Scheemda Gn", True, True),
    ("SCHERPENZEEL", "Scherpenzeel Fr", True, True),
    ("SCHEVENINGEN", "Scheveningen ZH", True, True),
    ("SCHIERMONNIKOOG", "Schiermonnikoog Fr - Skiermantseach Fr", True, True),
    ("SEVENUM", "Sevenum Lb", True, True),
    ("SLIEDRECHT", "Sliedrecht ZH", True, True),
    ("SLOCHTEREN", "Slochteren Gn", True, True),
    ("SMILDE", "Smilde Dr", True, True),
    ("SPAKENBURG", "Spakenburg Ut", True, True),
    ("STAVOREN", "Stavoren Fr - Starum Fr", True, False),
    ("TEGELEN", "Tegelen Lb", True, True),
    ("TIEL", "Tiel Gl", True, True),
    ("TILBURG", "Tilburg NB", True, True),
    ("URK", "Urk Fl", True, True),
    ("UTRECHT", "Utrecht Ut", True, True),
    ("VAALS", "Vaals Lb", True, True),
    ("VAASSEN", "Vaassen Gl", True, True),
    ("VEENENDAAL", "Veenendaal Ut", True, True),
    ("VENLO", "Venlo Lb", False, False),
    ("VOLENDAM", "Volendam NH", True, True),
    ("FRIEZENVEEN", "Vriezenveen Ov", True, True),
    ("WAGENBORGEN", "Wagenborgen Gn", True, True),
    ("WATERINGEN", "Wateringen ZH", True, True),
    ("WESTERBORK", "Westerbork Dr", True, True),
    ("WESTKAPELLE", "Westkapelle Ze", True, True),
    ("WIJHE", "Wijhe Ov", True, True),
    ("WILLEMSTAD", "Willemstad NB", True, True),
    ("WINDESHEIM", "Windesheim Ov", True, True),
    ("WISSENKERKE", "Wissekerke Ze", False, False),
    ("WOLVEGA", "Wolvega Fr", True, True),
    ("ZANDVOORT", "Zandvoort NH", True, True),
    ("ZEELAND", "Zeeland NB", True, True),
    ("ZOETERMEER", "Zoetermeer ZH", False, False),
    ("ZUIDZANDE", "Zuidzande Ze", True, True),
    ("ZUTPHEN", "Zutphen Gl", True, True),
    ("ZWARTSLUIS", "Zwartsluis Ov", True, True),
)
# Models by name, with the hub's names of those that it has.
MODELS = {
    "wav2vec2-large-960h": "facebook/wav2vec2-large-960h",
    "wav2vec2-large-nl-ft-cgn": "GroNLP/wav2vec2-dutch-large-ft-cgn",
    "wav2vec2-large-xlsr-53-ft-cgn": "GroNLP/wav2vec2-large-xlsr-53-ft-cgn",
}
# Linkage methods in the order of evaluation.
METHODS = ("sl", "cl", "ga", "wa", "uc", "wc", "wm")
LAYERS = range(1, 25)


def renames() -> dict[str, str]:
    """Locality of each key."""
    return {key: locality for key, locality, _, _ in LOCALITIES}


def rename_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(renames().items()), "village_key string, locality string")


def locality_table(spark: SparkSession) -> DataFrame:
    """locality, ord (by code point) and evaluated, of the localities in distance matrices."""
    rows = sorted((locality, evaluated) for _, locality, computed, evaluated in LOCALITIES if computed)
    return spark.createDataFrame([(n, i, evaluated) for i, (n, evaluated) in enumerate(rows)], "locality string, ord int, evaluated boolean")


def model_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODELS.items()), "model string, hub_id string")


def method_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, i) for i, m in enumerate(METHODS)], "method string, ord int")
