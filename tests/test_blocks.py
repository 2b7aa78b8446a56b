"""Large files by blocks against the whole file read by json.load, csv and a loop over lines."""

import csv
import io
import json
import random

import pytest

from granulon.sources import blocks, readers, sinks

SIZES = ["61", "1000", "128m"]


@pytest.fixture(params=SIZES)
def cut(spark, request):
    """Blocks of a few bytes up to whole files."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def elements(value):
    return sorted((k, json.dumps(e, sort_keys=True)) for k, v in value.items() if isinstance(v, list) for e in v if isinstance(e, dict))


ODD = ['a"b', "a\\", '\\"', "{[}]", "}}}", "{{{", '":[{', "é🎉 ", "", "\n\t", "images", '"images":[', "\\\\\\", "a}b"]


def document(seed):
    rng = random.Random(seed)
    text = lambda: rng.choice(ODD) + rng.choice(ODD)
    image = lambda i: {"id": i, "file_name": text(), "meta": {"k": [{"deep": text()}, text()], text(): {}}}
    note = lambda i: {"id": i, "image_id": rng.randrange(9), "segmentation": rng.choice([[[1.5, 2, 3, 4, 5, 6]], {"size": [4, 4], "counts": [3, 5]}]), "note": text()}
    return {
        "info": {"images": [{"not": "an element"}], "x": text()}, "images": [image(i) for i in range(rng.randrange(12))], "licences": [], "scalars": [1, "a}", [{"in": "an array"}], None],
        "annotations": [note(i) for i in range(rng.randrange(40))], text() + "k": [{"e": text()}], "last": text(),
    }


@pytest.mark.parametrize("seed", range(4))
def test_elements_equal_json_load(spark, cut, tmp_path, seed):
    files = {}
    for k, (indent, ascii_, tail) in enumerate([(None, True, ""), (2, False, "\n"), (None, False, " \n}"[:2])]):
        doc = document(10 * seed + k)
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(doc, indent=indent, ensure_ascii=ascii_) + tail)
        files[k] = doc
    got = blocks.json_elements(spark, str(tmp_path)).collect()
    for k, doc in files.items():
        own = [r for r in got if r.file.endswith(f"/{k}.json")]
        assert sorted((r.section, json.dumps(json.loads(r.text), sort_keys=True)) for r in own) == elements(doc)
        data = (tmp_path / f"{k}.json").read_bytes()
        assert all(data[r.at :].startswith(r.text.encode()) for r in own)


@pytest.mark.parametrize("text", ['{"images": [{"a": 1}, {"b": 2}', '{"images": [{"a": "1}]}', '{"images": [{"a": 1}]}}'])
def test_documents_that_are_not_closed(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(ValueError, match="closed"):
        blocks.json_elements(spark, str(tmp_path / "c.json"))


def test_empty_documents(spark, tmp_path):
    for name, text in (("a", ""), ("b", "{}"), ("c", '{"images": []}'), ("d", '{"images": [{}]}\n\n')):
        (tmp_path / f"{name}.json").write_text(text)
    assert [(r.section, r.text) for r in blocks.json_elements(spark, str(tmp_path)).collect()] == [("images", "{}")]


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"annotations": [{"id": i, "image_id": i % 7, "segmentation": {"counts": [1, 2]}} for i in range(20_000)]}))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        _, notes = readers.coco(spark, str(tmp_path / "c.json"))
        assert notes.rdd.getNumPartitions() > 10
        assert notes.select("id").distinct().count() == notes.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def plain_csv(text, fields):
    """Rows by Python's reader, with the physical line where each begins."""
    reader = csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""))
    header, out, row, before = None, [], 0, 0
    for cells in reader:
        line, before = before + 1, reader.line_num
        if not cells:
            continue
        row += 1
        if header is None:
            header = cells
            continue
        own = dict(zip(header, cells))
        extra = cells[len(header) :]
        out.append((*[own.get(f) for f in fields], line, row, "too many cells" if extra else "too few cells" if len(cells) < len(header) else None, extra or None))
    return sorted(out, key=lambda r: r[len(fields)])


FIELDS = ["a", "b", "c", "none"]


@pytest.mark.parametrize("seed", range(4))
def test_csv_equals_the_plain_reader(spark, cut, tmp_path, seed):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "x", 'in"side', '"quoted"', '"a,b"', '"two\nlines"', '"three\n\n"" ""\nlines"', '""', '""""', '"tail"x', "é🎉", " ", '"' + "long " * 30 + '\n"'])
    expected = []
    for k in range(2):
        end = rng.choice(["\n", "\r\n"])
        lines = [",".join(cell() for _ in range(rng.choice([3, 3, 3, 1, 5]))) if rng.random() > 0.1 else "" for _ in range(rng.randrange(60))]
        text = ("\ufeff" if k else "") + 'a,"b",c' + end + end.join(lines) + rng.choice(["", end])
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        expected.append(plain_csv(text, FIELDS))
    got = blocks.numbered_csv(spark, str(tmp_path), FIELDS).collect()
    for k in range(2):
        own = [(*r[:4], r._line, r._row, r._reason, r._surplus) for r in got if r._file.endswith(f"/{k}.csv")]
        assert sorted(own, key=lambda r: r[4]) == expected[k]


def test_csv_without_rows(spark, tmp_path):
    for name, text in (("a", ""), ("b", "a,b"), ("c", "\n\na,b\n"), ("d", 'a,"b\nb"\n')):
        (tmp_path / f"{name}.csv").write_text(text)
    assert blocks.numbered_csv(spark, str(tmp_path)).collect() == []
    assert blocks.numbered_csv(spark, str(tmp_path)).columns[:3] == ["a", "b", "b\nb"]


def test_a_quote_that_never_ends(spark, cut, tmp_path):
    text = 'a,b,c\n1,2,3\n4,"' + "open\n" * 100
    (tmp_path / "m.csv").write_text(text)
    got = [(*r[:4], r._line, r._row, r._reason, r._surplus) for r in blocks.numbered_csv(spark, str(tmp_path), FIELDS).collect()]
    assert sorted(got, key=lambda r: r[4]) == plain_csv(text, FIELDS)


def test_numbered_lines(spark, cut, tmp_path):
    lines = ["", "a", " b", "é" * 70, ""] * 20
    (tmp_path / "m.txt").write_text("\n".join(lines) + "\r\nlast")
    got = sorted((r.line, r.value) for r in blocks.numbered_lines(spark, str(tmp_path)).collect())
    assert got == list(enumerate([*lines, "last"], 1))


def test_manifest_of_json_lines_with_bad_ones(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"record_id": "r1"}\n\n{bad\n[1]\n{"record_id": 5}\n')
    got = readers.numbered_jsonl(spark, str(tmp_path / "m.jsonl"), ["record_id"]).collect()
    assert sorted((r._line, r.record_id, r._reason) for r in got) == [(1, "r1", None), (3, None, "not an object"), (4, None, "not an object"), (5, "5", None)]


def test_documents_of_splits(spark, tmp_path):
    images = spark.createDataFrame([(1, 'a "x"}', "train"), (2, "b", "val"), (3, "c", "train"), (4, "d", None)], "id int, file_name string, split string")
    notes = spark.createDataFrame([(7, 1, "train"), (8, 3, "train"), (9, 1, "train")], "id int, image_id int, split string")
    assert sinks.coco_splits(images, notes, str(tmp_path)) == ["train", "val"]
    read = lambda name: json.loads(next((tmp_path / f"instances_{name}.json").glob("part-*")).read_text())
    assert sorted(i["id"] for i in read("train")["images"]) == [1, 3] and len(read("train")["annotations"]) == 3
    assert read("val") == {"images": [{"id": 2, "file_name": "b"}], "annotations": [], "categories": [{"id": 1, "name": "particle"}]}


def test_document_in_parts(spark, tmp_path):
    """F8: many tasks write one document; copies of an element, empty lists and blocks that cut elements lose nothing."""
    import json

    members = {"none": spark.range(0).selectExpr("struct(id) AS e"), "images": spark.range(300).repartition(5).selectExpr("struct(id, concat('a }', id) AS t) AS e"), "notes": spark.range(40).repartition(4).selectExpr("struct('same' AS id) AS e")}
    path = str(tmp_path / "doc")
    sinks.document_parts(members, path, '"info": {"images": [{}]}, ')
    files = sorted(p for p in (tmp_path / "doc").rglob("part-*"))
    assert len(files) > 8
    whole = json.loads("".join(p.read_text() for p in files))
    assert whole["none"] == [] and sorted(e["id"] for e in whole["images"]) == list(range(300)) and whole["notes"] == [{"id": "same"}] * 40
    for size in ("61b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = [(r.section, json.loads(r.text)["id"]) for r in blocks.json_elements(spark, path, True).collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(got, key=str) == sorted([("images", i) for i in range(300)] + [("notes", "same")] * 40, key=str)
    (tmp_path / "doc" / "004").mkdir()
    (tmp_path / "doc" / "004" / "part-0").write_text("{")
    with pytest.raises(ValueError, match="isn't closed"):
        blocks.json_elements(spark, path, True)


def test_csv_is_read_by_one_python_worker_a_task(spark, tmp_path):
    """whole records are parsed where they are cut out; only those that span blocks pass another stage."""
    (tmp_path / "a.csv").write_text('a,b\n1,"x, y"\n2\n')
    read = blocks.numbered_csv(spark, str(tmp_path / "a.csv"), ["a", "b"])
    assert read._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.a, r.b, r._line, r._row, r._reason) for r in read.collect()) == [("1", "x, y", 2, 2, None), ("2", None, 3, 3, "too few cells")]
