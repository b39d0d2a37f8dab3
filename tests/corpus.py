"""Five documents, each there for an assertion."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tidewell.model import INPUT_SCHEMA
from tidewell.operators.build import build_index

HERE, NORTH, COLOGNE = (49.6116, 6.1319), (49.6516, 6.1319), (50.9375, 6.9603)


def scalar(kind, value):
    return (kind, str(value), None, None)


def listed(kind, *values):
    return (kind, None, list(values), None)


def doc(key, title="", body="", at=None, published="2026-01-01", **more):
    row = dict.fromkeys(f.split()[0] for f in INPUT_SCHEMA.replace("<type:string,scalar:string,list:array<string>,simple:string>", "").replace("decimal(12,2)", "d").replace("decimal(9,6)", "d").replace("map<string,struct>", "m").replace("map<string,array<string>>", "m").replace("map<string,string>", "m").split(", "))
    row |= {"doc_type": "thing", "doc_key": key, "status": "published", "language": "ru", "owner_key": "u1", "category_path": ["electronics", "phones"], "title": title, "body": body, "features": {}, "card": {"title": title}, "source_seq": 1}
    row["published_at"] = datetime.fromisoformat(published)
    if at:
        row["lat"], row["lon"] = (Decimal(str(x)) for x in at)
    return tuple((row | more)[k] for k in row)


ROWS = [
    doc("1", "Apple iPhone 13 Pro", "Отличные телефоны в идеальном состоянии", HERE, text_extra=["128 ГБ"], price_base=Decimal("500.00"), features={"brand": scalar("string", "apple"), "color": listed("select", "red"), "year": scalar("int", 2015), "tree": listed("hierarchical_select", "a", "b", "c")}),
    doc("2", "Samsung Galaxy", "самсунг телефон", NORTH, "2026-02-01", price_base=Decimal("300.00"), features={"brand": scalar("string", "samsung"), "color": listed("select", "blue", "red"), "year": scalar("int", 2014)}),
    doc("3", "Ноутбук Lenovo", "мощный ноутбук для работы", COLOGNE, "2026-03-01", category_path=["electronics", "laptops"], features={"brand": scalar("string", "lenovo"), "year": scalar("int", 2020)}),
    doc("4", "Antimeridian buoy", "floating near the date line", (0.5, 179.9), "2026-01-15", owner_key="u2", category_path=["marine"], price_base=Decimal("10.00"), features={"brand": scalar("string", "acme")}),
    doc("5", "Draft never published", "should never be findable", status="draft", price_base=Decimal("1.00"), features={"brand": scalar("string", "apple")}),
]


def index(spark, rows=None):
    return build_index(spark.createDataFrame(ROWS if rows is None else rows, INPUT_SCHEMA)).withColumn("indexed_at", F.lit("2026-04-01").cast("timestamp"))

WORDS = {"equivalents": [["couch", "sofa"]]}
