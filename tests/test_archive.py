"""Archive marts."""

import datetime as dt

from pyspark.sql import functions as F

from broadsheet.functions.dates import (edition_date_local, long_date_es, month_name_es, short_date_es,
                                        thousands_es)
from broadsheet.operators import archive as A
from conftest import one

SCHEMA = ("date string, items array<struct<rank int, title string>>, "
          "repos array<struct<name string>>")


def eds(spark):
    rows = [("2026-06-30", [(2, "b"), (1, "a")], None),
            ("2026-07-01", [(1, "c")], [("o/r",)]),
            ("2026-07-03", [(1, "d")], []),
            ("2026-07-18", [(1, "e")], [("o/s",)])]
    return spark.createDataFrame(rows, SCHEMA)


def test_spanish_dates_and_thousands(spark):
    assert one(spark, long_date_es(F.col("x")), rows=[("2026-07-18",)]) == ["Sábado, 18 de julio de 2026"]
    assert one(spark, short_date_es(F.col("x")), rows=[("2026-07-08",)]) == ["8 jul"]
    assert one(spark, month_name_es(F.col("x")), rows=[("2026-07",)]) == ["Julio de 2026"]
    assert one(spark, thousands_es(F.col("n")), schema="n long", rows=[(9312,), (19993,), (12,), (1234567,)]) == \
        ["9.312", "19.993", "12", "1.234.567"]


def test_edition_date_madrid_midnight(spark):
    got = one(spark, edition_date_local(F.col("t")), schema="t timestamp",
              rows=[(dt.datetime(2026, 7, 17, 21, 59),), (dt.datetime(2026, 7, 17, 22, 0),)])
    assert got == [dt.date(2026, 7, 17), dt.date(2026, 7, 18)]


def test_index_and_neighbours(spark):
    idx = {r["date"]: r for r in A.edition_index(eds(spark)).collect()}
    assert idx["2026-06-30"]["numero"] == 1 and idx["2026-07-18"]["numero"] == 4
    assert idx["2026-06-30"]["lead_title"] == "a"
    assert idx["2026-07-01"]["newer_path"] == "/2026/07/03/" and idx["2026-07-01"]["older_path"] == "/2026/06/30/"
    rep = {r["date"]: r for r in A.repos_edition_index(eds(spark)).collect()}
    assert set(rep) == {"2026-07-01", "2026-07-18"}
    assert rep["2026-07-01"]["repos_newer_path"] == "/repositorios/2026/07/18/"
    assert rep["2026-07-18"]["repos_older_path"] == "/repositorios/2026/07/01/"


def test_by_month_newest_first(spark):
    m = {r["month_key"]: r for r in A.by_month(eds(spark)).collect()}
    assert m["2026-07"]["dates_desc"] == "2026-07-18,2026-07-03,2026-07-01"
    assert m["2026-06"]["month_title"] == "Junio de 2026"


def test_calendar_grid(spark):
    g = {r["date"]: r for r in A.calendar_grid(eds(spark)).collect()}
    assert len(g) == 61
    first_july = g[dt.date(2026, 7, 1)]
    assert first_july["offset"] == 2 and first_july["available"] and first_july["url"] == "/2026/07/01/"
    assert not g[dt.date(2026, 7, 2)]["available"]
    assert g[dt.date(2026, 7, 18)]["is_current"]
    assert not g[dt.date(2026, 6, 1)]["prev_enabled"] and g[dt.date(2026, 7, 1)]["prev_enabled"]


def test_pending_editions(spark):
    runs = spark.createDataFrame([(dt.date(2026, 7, 18),), (dt.date(2026, 7, 19),)], "edition_date date")
    assert [r[0] for r in A.pending_editions(runs, eds(spark)).collect()] == [dt.date(2026, 7, 19)]
