import csv
import io
import json
import random
import tarfile

import pytest
from pyspark.sql import Observation

from tracelink.sources import archives, quoted, readers, writers

VOLUME = """<collection id="2024.acl"><volume id="long"><meta><booktitle>Proc</booktitle><year>2024</year></meta>
<paper id="1"><title>On <fixed-case>BERT</fixed-case> \n use</title><author><first>Ada</first><last>L</last></author><author><last>Noor</last></author><doi>10.1/a</doi></paper>
<paper id="2"><title> </title></paper><paper id="3"><title>Old</title><year>x1</year></paper></volume></collection>"""


def test_archive_to_papers(spark, tmp_path):
    path = tmp_path / "a.tar.gz"
    with tarfile.open(path, "w:gz") as tar:
        for name, body in (("r/data/xml/2024.acl.xml", VOLUME), ("r/data/xml/P19.xml", "<broken"), ("r/other/x.xml", VOLUME)):
            info = tarfile.TarInfo(name)
            info.size = len(body.encode())
            tar.addfile(info, io.BytesIO(body.encode()))
    rows = readers.volume_papers(readers.volume_archives(spark, str(path))).orderBy("paper_id").collect()
    assert [(r.acl_id, r.title, r.year, r.authors, r.n_authors, r.venue_key, r.has_doi) for r in rows] == [
        ("2024.acl-long.1", "On BERT use", 2024, "Ada L; Noor", 2, "acl", True),
        ("2024.acl-long.3", "Old", None, "", 0, "acl", False),
    ]


def test_collection_without_id_goes_by_its_file(spark):
    raw = b"<collection><volume><paper><title>T</title></paper></volume><x><volume id='2'><paper id='1'><title>not a child</title></paper></volume></x></collection>"
    rows = readers.volume_papers(spark.createDataFrame([("2020.x.xml", raw)], readers.VOLUMES)).collect()
    assert [(r.acl_id, r.collection_id) for r in rows] == [("2020.x-.", "2020.x")]


def test_works(spark, tmp_path):
    page = {"meta": {"count": 3}, "results": [{"id": "https://x/W1", "doi": "https://doi.org/10.1/A", "title": "t", "publication_year": 2020, "ids": {"mag": "5"}}, {"id": "W2", "primary_location": {"source": {"display_name": "V"}}}]}
    (tmp_path / "1.json").write_text(json.dumps(page))
    rows = readers.works(spark, str(tmp_path)).orderBy("openalex_id").collect()
    assert [(r.openalex_id, r.doi_norm, r.mag_id, r.oa_source) for r in rows] == [("W1", "10.1/a", "5", None), ("W2", None, None, "V")]
    assert readers.incomplete_pages(spark, str(tmp_path)).count() == 1


def test_a_query_does_not_hide_another(spark, tmp_path):
    for query, count, landed in (("a", 1, 3), ("b", 3, 1)):
        (tmp_path / query).mkdir()
        (tmp_path / query / "1.json").write_text(json.dumps({"meta": {"count": count}, "results": [{"id": f"W{i}"} for i in range(landed)]}))
    assert [tuple(r) for r in readers.incomplete_pages(spark, f"{tmp_path}/*").collect()] == [("b", 3, 1)]


def test_citations(spark, tmp_path):
    (tmp_path / "c.csv").write_text("RefType , confscore,oaid,patent,wherefound\napp, 10 ,1,us-1, both\nexm,x,2,us-2,bodyonly\napp,3\n")
    rows = readers.citations(spark, str(tmp_path / "c.csv")).orderBy("oaid").collect()
    assert [(r.reftype, r.confscore, r.oaid, r.wherefound) for r in rows] == [("app", 10.0, "1", "both"), ("exm", None, "2", "bodyonly")]


def test_awards(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Agency,Award Year,My Abstract,Solicitation Number\nDOD,2020,"two\nlines, ""quoted""",S1\n')
    row = readers.awards(spark, str(tmp_path / "a.csv")).first()
    assert (row.agency, row.year, row.abstract, row.solicitation, row.branch) == ("DOD", "2020", 'two\nlines, "quoted"', "S1", None)
    assert readers.pick(["My Abstract", "abstract"], "Abstract") == "abstract"
    assert readers.pick(["Solicitation X", "a Solicitation Number"], "Solicitation Number", "Solicitation") == "a Solicitation Number"
    assert readers.pick(["x", "y"], "z") is None and readers.pick(["year", "Award Year"], "Award Year", "Year") == "Award Year"


def test_patents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"patent_id": "us-1", "title": "t"}))
    (tmp_path / "b.json").write_text(json.dumps({"patent_id": "us-2", "_absent": True}))
    (tmp_path / "c.json").write_text("{broken")
    assert [r.patent_id for r in readers.patent_meta(spark, str(tmp_path)).collect()] == ["us-1"]
    html = "<title>A &amp; B - US1</title><div>Abstract:</div><div><p>Some <b>text</b></p></div>"
    row = readers.patent_pages(spark.createDataFrame([("us-1", html)], "patent_id string, html string")).first()
    assert (row.title, row.abstract, row.assignee) == ("A & B", "Some text", None)
    html = "<div>Assignee:</div><div>Nobody</div>"
    assert readers.patent_pages(spark.createDataFrame([("us-1", html)], "patent_id string, html string")).count() == 0
    hits = [{"id": "x"}, {"patent": {"publication_number": "US10494607B2", "title": "neighbour"}}, {"patent": {"publication_number": "us-1049460", "title": "hit"}}, {"patent": {"publication_number": "US1049460", "title": "second"}}]
    body = json.dumps({"results": {"cluster": [{}, {"result": hits}]}})
    rows = readers.patent_search(spark.createDataFrame([("us-1049460", body), ("us-2", body), ("us-3", "{")], "patent_id string, body string")).collect()
    assert [(r.patent_id, r.title) for r in rows] == [("us-1049460", "hit")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], "a int, b string")
    writers.summary(rows, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).columns == ["a", "b"]
    writers.sheet(rows, str(tmp_path / "c"))
    writers.parquet(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


# Archives as streams


def packed(path, members, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))


@pytest.mark.parametrize(("ending", "mode"), [("tar", "w"), ("tar.gz", "w:gz"), ("tar.bz2", "w:bz2")])
def test_archive_members(spark, tmp_path, ending, mode):
    long = "x/" + "deep/" * 60 + "data/xml/long.xml"  # a name that takes a header of its own
    members = [(f"r/data/xml/{i}.xml", bytes([i]) * (i * 700)) for i in range(40)] + [(long, b"l"), ("r/data/xml/no.txt", b"n"), ("other/a.xml", b"o"), ("r/data/xml/big.xml", bytes(3_000_000))]
    for k in range(2):
        packed(tmp_path / f"{k}.{ending}", members, mode)
    got = archives.archive_members(spark, str(tmp_path / f"*.{ending}")).collect()
    want = {n: b for n, b in members if "/data/xml/" in n and n.endswith(".xml")}
    assert len(got) == 2 * len(want) and all(bytes(r.raw) == want[r.name] for r in got) and len({r.archive for r in got}) == 2
    first = archives.volumes(spark, str(tmp_path / f"*.{ending}"), most=2).collect()
    assert sorted(r.source for r in first) == ["0.xml", "0.xml", "1.xml", "1.xml"]


def test_empty_archive(spark, tmp_path):
    packed(tmp_path / "a.tar", [])
    (tmp_path / "b.tar").write_bytes(b"")
    assert archives.archive_members(spark, str(tmp_path / "*.tar")).count() == 0


def test_a_task_holds_a_member_and_not_an_archive():
    """Of 60 members of 100 kB, no more than a record and a block are held at a time."""
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        for i in range(60):
            info = tarfile.TarInfo(f"{i}.xml")
            info.size = 100_000
            tar.addfile(info, io.BytesIO(bytes(100_000)))
    raw, most = buffer.getvalue(), 0
    stream = archives._Blocks(raw[i : i + 512] for i in range(0, len(raw), 512))
    with tarfile.open(fileobj=stream, mode="r|") as tar:
        for m in tar:
            tar.extractfile(m).read()
            most = max(most, len(stream.held))
            tar.members = []
    assert most <= 10_240 + 512


# Quoted CSV by many tasks


@pytest.mark.parametrize("split", [300, 2_000, 1 << 27])
def test_quoted_csv_like_one_task(spark, tmp_path, split):
    rng = random.Random(split)
    for f in range(2):
        with open(tmp_path / f"{f}.csv", "w", newline="", encoding="utf-8") as out:
            w = csv.writer(out, lineterminator="\n")
            w.writerow(["a", 'b "x"', "c"])
            for i in range(120):
                w.writerow([i, "".join(rng.choice('ab"\n,é ') for _ in range(rng.choice([0, 3, 10, 60, 3_000 if i % 41 == 0 else 5]))), f"v{i}"])
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, (str(split), "0")):
        spark.conf.set(n, v)
    try:
        got = quoted.quoted_csv(spark, str(tmp_path))
        want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
        assert got.columns == want.columns
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
        assert split > 2_000 or len(quoted.split_states(spark, str(tmp_path))) > 5
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_quoted_csv_edges(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'x,y\r\n1,"two\r\nlines"\r\n\r\n2,\r\n"3","no end of line"')
    rows = quoted.quoted_csv(spark, str(tmp_path / "a.csv"), "x int, y string").orderBy("x").collect()
    assert [(r.x, r.y.replace("\r", "") if r.y else r.y) for r in rows] == [(1, "two\nlines"), (2, None), (3, "no end of line")]
    (tmp_path / "b.csv").write_text("x,y\n")
    assert quoted.quoted_csv(spark, str(tmp_path / "b.csv")).count() == 0


# Counters


def test_counters(spark, tmp_path):
    (tmp_path / "c.csv").write_text("reftype,confscore,oaid,patent,wherefound\n　app\t,1,1,us-1,body\nexm,2,2,us-2,body\napp,3\napp,4,,us-3,body\n", encoding="utf-8")
    read, kept = Observation("r"), Observation("k")
    rows = readers.citations(spark, str(tmp_path / "c.csv"), read, kept).collect()
    assert (read.get["n"], kept.get["n"], len(rows)) == (4, 2, 2) and rows[0].reftype == "app"
