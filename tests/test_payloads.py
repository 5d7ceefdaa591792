import json
import re

from dossierflow.operators.parse import parse_payloads
from dossierflow.sources import payloads


def rows(spark):
    docs = [
        {"document": {"elements": [{"content": "a"}, {"content": None}, {"id": 1, "content": 7}]}, "error_status": None, "pages": 3},
        {"document": {"elements": []}, "error_status": None},
        {"document": {"elements": [{"content": "b"}]}, "error_status": "E1"},
        {"document": {"elements": "none"}}, {"document": {}}, [1, 2], "text",
    ]
    texts = [json.dumps(d) for d in docs] + ["{broken", None, ""]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, payload string").repartition(2)


def test_same_as_parsing_the_payload(spark, tmp_path):
    df, folder = rows(spark), str(tmp_path / "p")
    payloads.write(df.filter("doc_id < 4"), folder)
    payloads.write(df.filter("doc_id >= 4"), folder)
    got = payloads.parse_shredded(payloads.read(spark, folder)).select("doc_id", "document_text", "parse_error")
    want = parse_payloads(df).select("doc_id", "document_text", "parse_error")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    pages = payloads.at_path(payloads.read(spark, folder), "$.pages", "int", "n").collect()
    assert {r.doc_id: r.n for r in pages}[0] == 3


def test_only_the_needed_columns_are_scanned(spark, tmp_path):
    folder = str(tmp_path / "p")
    payloads.write(rows(spark), folder)
    read = payloads.read(spark, folder)
    schema = lambda df: re.findall(r"ReadSchema: struct<(.*)>", df._jdf.queryExecution().toString())[0]
    assert "document" not in schema(payloads.parse_shredded(read).select("doc_id", "document_text"))
    assert schema(read.select("error_status")) == "error_status:string"
