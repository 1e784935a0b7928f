"""Social posts."""

from pyspark.sql import functions as F

from broadsheet.functions.social import (apply_bold, assemble_linkedin, assemble_x, bold_sans,
                                         clean_hashtags, clean_hashtags_variant, strip_fences)
from conftest import one

URL = "https://news.example/item"


def _x(spark, hook, tags):
    df = spark.createDataFrame([(hook, tags)], "h string, t array<string>")
    return df.select(assemble_x(F.col("h"), F.col("t"), F.lit(URL))).collect()[0][0]


def test_bold_sans(spark):
    assert one(spark, bold_sans(F.col("x")), rows=[("Az9-ñ",)]) == ["𝗔𝘇𝟵-ñ"]


def test_apply_bold_lazy(spark):
    got = one(spark, apply_bold(F.col("x")), rows=[("a **bold** b",), ("***a***",), ("**open\nline**",)])
    assert got == ["a 𝗯𝗼𝗹𝗱 b", "*𝗮*", "**open\nline**"]


def test_assemble_x_fits_with_tags(spark):
    assert _x(spark, "Short hook", ["#IA", "#Datos"]) == f"Short hook\n\n#IA #Datos\n{URL}"


def test_assemble_x_drops_tags_then_truncates(spark):
    hook = "h" * 253
    assert _x(spark, hook, ["#IA"]) == f"{hook}\n{URL}"
    long = ("word " * 120).strip()
    out = _x(spark, long, ["#IA"])
    body = out.split("\n")[0]
    assert body.endswith("…") and len(body) <= 256 and not body[:-1].endswith(" ")


def test_assemble_linkedin(spark):
    df = spark.createDataFrame([("Idea **clave**", ["#IA"]), ("Solo", [])], "h string, t array<string>")
    got = [r[0] for r in df.select(assemble_linkedin(F.col("h"), F.col("t"), F.lit(URL))).collect()]
    assert got == [f"Idea 𝗰𝗹𝗮𝘃𝗲\n\n#IA\n\n{URL}", f"Solo\n\n{URL}"]


def test_clean_hashtags(spark):
    got = one(spark, clean_hashtags(F.col("x")), schema="x array<string>",
              rows=[(["IA", "#ML", "#", None, "a", "b", "c"],)])
    assert got == [["#IA", "#ML", "#a", "#b"]]


def test_clean_hashtags_variant_ignores_numbers(spark):
    got = one(spark, clean_hashtags_variant(F.parse_json(F.col("x"))),
              rows=[('{"hashtags": ["uno", 5, "#dos", null]}',), ('{"hashtags": "solo"}',)])
    assert got == [["#uno", "#dos"], []]


def test_strip_fences(spark):
    got = one(spark, strip_fences(F.col("x")), rows=[("```json\n{\"a\": 1}\n```",), (" plain ",)])
    assert got == ['{"a": 1}', "plain"]
