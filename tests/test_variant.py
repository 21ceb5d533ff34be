"""JSON-LD blocks are parsed once each, and fields are parts of the parsed value."""

import json

from hearthlake.sources.details import DETAILS, detail_rows, ld_images, part

LISTING = {"@type": "Product", "name": "Huis", "offers": {"price": "1200", "priceCurrency": "EUR"}, "image": [{"url": "https://a/1.jpg"}, "https://a/2.jpg", {"x": 1}, 5]}


def page(*blocks):
    return "<html><body>" + "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks) + "</body></html>"


def test_blocks_lists_and_graphs_are_opened(spark):
    other = {"@type": "Organization", "name": "Other"}
    pages = {"plain": page(other, LISTING), "list": page([other, LISTING]), "graph": page({"@graph": [other, LISTING]}), "kinds": page(other, {**LISTING, "@type": ["Thing", "Product"]}), "broken": page("{not json", LISTING)}
    from pyspark.sql import functions as F

    from hearthlake.sources import details
    from hearthlake.sources.html import extracted

    rows = extracted(spark.createDataFrame(list(pages.items()), "url string, html string"), None, details.COMMON).withColumn("node", details.ld_block(("product",), True))
    found = {r["url"]: r for r in rows.select("url", part("node", "name").alias("name"), part("node", "offers.price").alias("price"), ld_images().alias("images"), F.col("node").isNull().alias("none")).collect()}
    for url in pages:
        assert (found[url]["name"], found[url]["price"], found[url]["images"]) == ("Huis", "1200", "https://a/1.jpg\nhttps://a/2.jpg"), url


def test_one_parse_in_the_plan(spark):
    pages = spark.createDataFrame([("u", page(LISTING))], "url string, html string")
    for source in DETAILS:
        assert detail_rows(pages, source)._jdf.queryExecution().optimizedPlan().toString().count("parse_json(") <= 1, source
