"""CSV and JSON read in byte ranges against Python's own parsers, at many range sizes."""

import csv
import io
import json
import random

import pyarrow as pa
import pytest

from sievemark.sources import readers
from sievemark.sources.ranges import END, _json_cut, csv_records, dealt, inside_after, nested, pieces_of
from sievemark.sources.readers import column_names, json_lines, read_csv, read_json

CELLS = ["plain", "", "with, comma", 'say ""twice""', "two\nlines", "dos\r\nlines", 'quote " inside', "\n", '"', '""', "end\n", "é漢", " blank ", ",", '",\n"', "a" * 90]


@pytest.fixture
def range_size(spark):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def written(path, rows, end="\n", encoding="utf-8"):
    text = io.StringIO(newline="")
    csv.writer(text, lineterminator=end).writerows(rows)
    path.write_bytes(text.getvalue().encode(encoding))


def texts(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cells_with_line_breaks_at_every_range_size(spark, tmp_path, range_size, end):
    rng = random.Random(1)
    rows = [[str(i), rng.choice(CELLS), rng.choice(CELLS), "z"] for i in range(60)]
    for k in range(2):
        written(tmp_path / f"{k}.csv", [["id", "first\nname", "b", "c"], *rows[k::2]], end)
    wanted = sorted((r[0], r[1] or "null", r[2] or "null", r[3]) for r in rows)
    for size in (53, 5000) if end == "\n" else (97,):
        range_size(size)
        frame = read_csv(spark, str(tmp_path), infer=False, na_values=("",)).fillna("null")
        assert frame.columns == ["id", "first\nname", "b", "c"]
        assert texts(frame) == wanted, size


def test_one_file_has_many_tasks_and_quotes_inside_plain_cells_mean_nothing(spark, tmp_path, range_size):
    path = tmp_path / "one.csv"
    rows = [f'{i},5" pipe,"a{i}\nb"' if i % 7 == 0 else f'{i},5" and 6" pipes,x' for i in range(400)]
    path.write_text("id,size,note\n" + "\n".join(rows) + "\n\n\n")
    range_size(900)
    frame = read_csv(spark, str(path), infer=False)
    assert frame.rdd.getNumPartitions() > 8
    assert texts(frame) == sorted((str(i), '5" pipe', f"a{i}\nb") if i % 7 == 0 else (str(i), '5" and 6" pipes', "x") for i in range(400))


def test_encodings_and_types_file_by_file(spark, tmp_path, range_size):
    written(tmp_path / "a.csv", [["id", "word", "x"], *[[str(i), "café\nthé", "1.5"] for i in range(50)]], encoding="latin-1")
    written(tmp_path / "b.csv", [["id", "word", "x"], *[[str(i), "漢", "N/A"] for i in range(50, 90)]])
    (tmp_path / "c.csv").write_bytes(b"")
    for size in (40, 10_000):
        range_size(size)
        frame = read_csv(spark, str(tmp_path))
        assert dict(frame.dtypes) == {"id": "bigint", "word": "string", "x": "double"}
        assert texts(frame.fillna(-1)) == sorted((i, "café\nthé", 1.5) if i < 50 else (i, "漢", -1.0) for i in range(90))


def test_line_states_equal_a_letter_by_letter_machine():
    def slow(line, inside):
        state = "quoted" if inside else "start"
        for c in line:
            if state == "quoted":
                state = "perhaps" if c == '"' else "quoted"
            elif state == "perhaps":
                state = "quoted" if c == '"' else "start" if c == "," else "plain"
            elif state == "start":
                state = "quoted" if c == '"' else "start" if c == "," else "plain"
            else:
                state = "start" if c == "," else "plain"
        return state == "quoted"

    rng = random.Random(2)
    for _ in range(20_000):
        line = "".join(rng.choice('"",ab') for _ in range(rng.randint(0, 12)))
        for inside in (False, True):
            assert inside_after(line.encode(), inside) == slow(line, inside), (line, inside)
    assert inside_after(b'"' + b'""' * 500_000, False) and not inside_after(b'"' + b'a,' * 500_000 + b'"', False)


def test_json_states_equal_a_letter_by_letter_machine():
    def slow(piece, inside):
        deep, hidden = 0, False
        for c in piece + "}":
            if hidden:
                hidden = False
            elif c == "\\":
                hidden = True
            elif c == '"':
                inside = not inside
            elif not inside:
                deep += (c in "{[") - (c in "}]")
        return inside, deep

    rng = random.Random(3)
    for _ in range(20_000):
        piece = "".join(rng.choice('""\\\\{[]ab,') for _ in range(rng.randint(0, 12)))
        if not (len(piece) - len(piece.rstrip("\\"))) % 2:  # no JSON text has a backslash before a brace
            for inside in (False, True):
                assert nested(piece.encode(), inside) == slow(piece, inside), (piece, inside)


def test_header_names():
    assert column_names('a,,b,"x\ny",B') == ["a", "_c1", "b2", "x\ny", "B4"]


OBJECTS = [{"id": i, "text": t, "deep": {"a": [{"b": i}, {"c": "}"}], "d": "x{[\"\\"}} for i, t in enumerate(
    ["plain", "brace } in text", 'quote " and }', "back\\slash", "\\\"}", "[", "", "é漢", "}}}", '{"a": 1}', " ", "tab\tnew\nline"] * 2)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_at_every_range_size(spark, tmp_path, range_size, indent):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps(OBJECTS[k::2], indent=indent, ensure_ascii=k == 0))
    for size in (83, 100_000):
        range_size(size)
        rows = read_json(spark, str(tmp_path)).orderBy("id").collect()
        assert [r.asDict(recursive=True)["text"] for r in rows] == [o["text"] for o in OBJECTS]
        assert [r["id"] for r in rows] == list(range(len(OBJECTS)))
        assert [r["deep"]["a"][0]["b"] for r in rows] == list(range(len(OBJECTS)))


def test_json_layouts_side_by_side(spark, tmp_path, range_size):
    (tmp_path / "lines.json").write_text("".join(json.dumps({"id": i}) + "\n" for i in range(30)))
    (tmp_path / "array.json").write_text(json.dumps([{"id": i} for i in range(30, 60)], indent=1))
    (tmp_path / "one.json").write_text(json.dumps({"id": 60}, indent=4))
    (tmp_path / "several.json").write_text("\n".join(json.dumps({"id": i}, indent=2) for i in range(61, 70)))
    (tmp_path / "mark.json").write_bytes(b"\xef\xbb\xbf" + json.dumps([{"id": 70}, {"id": 71}]).encode())
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "void.json").write_text("")
    for size in (29, 10_000):
        range_size(size)
        assert sorted(r["id"] for r in read_json(spark, str(tmp_path)).collect()) == list(range(72))


@pytest.mark.parametrize("text", ['[{"id": 1}, {"id": 2', '{"id": {"a": 1}', '[{"id": "open}]'])
def test_json_that_ends_too_soon_is_an_error(spark, tmp_path, range_size, text):
    (tmp_path / "bad.json").write_text(text)
    (tmp_path / "good.json").write_text('[{"id": 1}]')
    for size in (13,):
        range_size(size)
        with pytest.raises(ValueError, match="bad.json"):
            read_json(spark, str(tmp_path))


def test_ranges_are_cut_once_however_often_the_records_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'k,t\n1,"x\ny"\n2,z\n')
    found = csv_records(spark, str(tmp_path / "a.csv"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Sort" not in plan
    assert sorted(bytes(r["record"]) for r in found.collect()) == [b'1,"x\ny"', b"2,z", b"k,t"]


LAYOUTS = {
    "": None, "\n": True, " \r\n\n": True, '{"a": 1}': True, '{"a": 1}\n': True, '{"a": 1}  \n\n  {"a": "\u00e9"} ': True, '\n {"a": {"b": 1}}\r\n{"a": {}}': True,
    '{"a": 1}\r{"a": 2}\r': True, '[{"a": 1}, {"a": 2}]': False, '{"a": {"b": 1}\n}': False, '{"a": {"b": 1}\n}\n': False, '{\n"a": 1}': False, '{"a": 1}\n{"a":\n2}': False,
    '{"a": 1}\n1\n{"a": 2}': False, '{"a": 1}\n{"a": 2': False, '{"a": 1}\n[{"a": 2}]': False, '{"a": {"b": 1}\n, "c": {}}': False, '{"a": 1} 2': False, '{"a": 1}\n\n}\n': False,
}


def test_json_lines_are_told_from_other_layouts_without_reading_a_line_whole(spark, tmp_path, range_size):
    import gzip

    for k, (text, wanted) in enumerate(LAYOUTS.items()):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}/a.json").write_bytes(text.encode())
        (tmp_path / f"{k}z").mkdir()
        (tmp_path / f"{k}z/a.json.gz").write_bytes(gzip.compress(text.encode()))
        range_size(7 if k % 2 else 1000)
        assert json_lines(spark, str(tmp_path / f"{k}")) is wanted, text
        assert bool(json_lines(spark, str(tmp_path / f"{k}z"))) is bool(wanted and text.strip()), text
    (tmp_path / "mark.json").write_bytes(b"\xef\xbb\xbf" + b'{"a": 1}\n{"a": 2}\n')
    assert json_lines(spark, str(tmp_path / "mark.json"))


def test_an_array_in_one_line_is_no_single_row_of_any_pass(spark, tmp_path, range_size, monkeypatch):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i} for i in range(500)]))
    range_size(300)
    read = type(spark.read)

    def by_line(reader, path, *rest, made=read.text):
        assert getattr(reader, "_sep", None) or not str(path).endswith("a.json"), "read by lines"
        return made(reader, path, *rest)

    def option(reader, key, value, made=read.option):
        made(reader, key, value)
        reader._sep = key == "lineSep" or getattr(reader, "_sep", None)
        return reader

    monkeypatch.setattr(read, "text", by_line)
    monkeypatch.setattr(read, "option", option)
    assert read_json(spark, str(tmp_path / "a.json")).count() == 500


def test_small_ranges_share_tasks_and_what_is_written_makes_few(spark, tmp_path, range_size):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i, "t": "x} {"} for i in range(600)]))
    range_size(50)
    most = 4 * spark.sparkContext.defaultParallelism
    pieces = dealt(pieces_of(spark, str(tmp_path / "a.json"), "}"))
    assert pieces.rdd.getNumPartitions() <= most
    ranges, lines = pieces.select("block").distinct().count(), [r["line"] for r in pieces.orderBy("block", "line").collect()]
    assert ranges > 4 * most and len({*lines}) == len(lines) == 1201
    frame = read_json(spark, str(tmp_path / "a.json"))
    assert frame.rdd.getNumPartitions() <= 2 * most
    assert sorted(r["id"] for r in frame.collect()) == list(range(600))


def in_batches(pieces, at, state, size):
    rows = [(piece.encode() + END, f"{block} {state[block]} f") for piece, block in zip(pieces, at)]
    for k in range(0, len(rows), size):
        part = rows[k:k + size]
        yield pa.RecordBatch.from_pydict({"piece": [r[0] for r in part], "place": [r[1] for r in part]})


def test_values_are_cut_alike_however_their_pieces_are_dealt_to_batches_and_ranges():
    rng = random.Random(4)
    for _ in range(300):
        values = [{"i": i, "t": rng.choice(["", "}", "\\", '"', "{[", "a\nb", "\\}", "}}\"{"]), "d": rng.choice([{}, [{}], {"x": {"y": "}"}}, [1, [2, {}]]])} for i in range(rng.randint(0, 12))]
        array = rng.random() < 0.7
        text = json.dumps(values, indent=rng.choice([None, 2, 20])) if array else rng.choice(["", "\n", ", \r\n "]).join(map(json.dumps, values)) + rng.choice(["", " ", "\n"])
        pieces, block, at, state, inside, depth = text.split("}"), 0, [], {}, False, 0
        for k, piece in enumerate(pieces):
            if not k or rng.random() < 0.2:
                block = k
                state[k] = 2 * (depth - array) + inside
            at.append(block)
            inside, grown = nested(piece.encode(), inside)
            depth += grown
        found = [r for b in _json_cut(in_batches(pieces, at, state, rng.choice([1, 2, 3, 50]))) for r in b.to_pylist()]
        lines = [x for r in found if r["complete"] for x in r["record"].decode().split("\n")]
        parts, held = sorted((r["block"], r["line"], r["begins"], r["record"].decode()) for r in found if not r["complete"]), []
        for *_, begins, record in parts:
            held = [*held, record] if begins else [*held[:-1], held[-1] + record]
        assert sorted((json.loads(x) for x in lines + held), key=lambda v: v["i"]) == values, text


def test_a_file_that_begins_as_an_array_is_not_looked_through(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text('[{"id": 1},\n{"id": 2}]')
    monkeypatch.setattr(readers.F, "bool_and", None)
    assert json_lines(spark, str(tmp_path)) is False
