"""Small tables and plain Python forms of the text rules."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(text or "")


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def texts(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
