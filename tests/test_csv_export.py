"""CSV exports: one header over all parts, or one in each."""

import csv
import glob
import io
import tempfile

import pytest

from sitegraph.sources.io import BOM, export_csv, read_csv_export

ROWS = [("https://a/%d" % k, None if k % 7 == 0 else "", 'say "hi", %d' % k if k % 2 else "two\nlines", k) for k in range(50)]


@pytest.fixture()
def view(spark):
    return spark.createDataFrame(ROWS, "url string, `page title` string, `h1, first` string, n int").repartitionByRange(4, "n") \
        .sortWithinPartitions("n")


def joined(path):
    return b"".join(open(p, "rb").read() for p in sorted(glob.glob(path + "/part-*"))).decode()


def test_parts_put_together_are_one_file(spark, view):
    path = tempfile.mkdtemp(prefix="csv-") + "/out"
    export_csv(view, path)
    text = joined(path)
    assert text.startswith(BOM) and text.count(BOM) == 1
    head, *rows = csv.reader(io.StringIO(text.lstrip(BOM)))
    assert head == view.columns
    assert rows == [[u, "\\N" if t is None else t, h, str(n)] for u, t, h, n in ROWS]


@pytest.mark.parametrize("bom", [True, False])
@pytest.mark.parametrize("one_header", [True, False])
def test_reads_back_both_forms(spark, view, bom, one_header):
    path = tempfile.mkdtemp(prefix="csv-") + "/out"
    export_csv(view, path, bom=bom, one_header=one_header)
    assert sorted(map(tuple, read_csv_export(spark, path, view.schema).collect())) == sorted(ROWS, key=lambda r: r[0])
    loose = read_csv_export(spark, path)
    assert loose.columns == view.columns
    assert {r[3] for r in loose.collect()} == {str(k) for k in range(50)}


def test_empty_view_keeps_its_header(spark, view):
    path = tempfile.mkdtemp(prefix="csv-") + "/out"
    export_csv(view.where("n < 0"), path)
    assert joined(path) == BOM + 'url,page title,"h1, first",n\n'
    assert read_csv_export(spark, path).columns == view.columns
    assert read_csv_export(spark, path, view.schema).collect() == []
