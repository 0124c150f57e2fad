"""Extraction on pages written by hand, none of them from the generator of layouts, and the time of malformed ones."""

import os
import sys
import time

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pages_by_hand import PAGES  # noqa: E402

from gridloom.llm import html_extraction  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_pages_by_hand(spark):
    field = html_extraction.train(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    rows = spark.createDataFrame([(k, name, html) for k, (name, (html, _)) in enumerate(PAGES.items())], "page_id bigint, url string, html string")
    found = {r["url"]: r["text"] for r in html_extraction.extract(rows, field).collect()}
    assert len(PAGES) >= 30 and {name: text for name, text in found.items() if text != PAGES[name][1]} == {}


@pytest.mark.parametrize("page", ["<p>" + "<i>x</b>" * 125_000, "<b><p>" + "<i>x</b>" * 125_000, "<div>" + "</p></span>x" * 90_000])
def test_a_megabyte_of_unmatched_end_tags(page):
    began = time.perf_counter()
    blocks = html_extraction.blocks_of(page)
    assert time.perf_counter() - began < 5 and "".join(b.text for b in blocks).count("x") >= 90_000
