"""Fingerprints over byte ranges, first lines, quoted records, spans and ranks, each against a plain version."""

import csv
import hashlib
import io
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quarterlight.operators import compare, ranks, records
from quarterlight.sources import byte_ranges, documents, listing, schedules


def plain_root(content, leaf, fanout):
    level = [hashlib.sha256(b"L" + content[i : i + leaf]).hexdigest() for i in range(0, max(1, len(content)), leaf)]
    while len(level) > 1:
        level = [hashlib.sha256(("N" + "".join(level[i : i + fanout])).encode()).hexdigest() for i in range(0, len(level), fanout)]
    return level[0]


def test_merkle_roots_of_files(spark, tmp_path):
    """The same whatever range a task reads; one late byte changes it; files without bytes count."""
    rng = random.Random(1)
    contents = [b"", b"x", b"y" * 64, rng.randbytes(64 * 9 + 5), rng.randbytes(5000)]
    contents.append(contents[-1][:-1] + bytes([contents[-1][-1] ^ 1]))
    files = []
    for i, content in enumerate(contents):
        (tmp_path / f"f {i}.bin").write_bytes(content)
        files.append((f"file:{tmp_path}/f {i}.bin", len(content)))
    for split in (1, 200, 1 << 20):
        leaves = byte_ranges.file_leaves(spark, files, 64, split)
        got = {r["path"]: r["root"] for r in byte_ranges.merkle_roots(leaves, 79, fanout=3).collect()}
        assert got == {path: plain_root(c, 64, 3) for (path, _), c in zip(files, contents)}
    assert got[files[4][0]] != got[files[5][0]]
    assert byte_ranges.merkle_roots(byte_ranges.file_leaves(spark, []), 1).collect() == []


def test_inventory_of_large_files(spark, tmp_path):
    for name, body in (("FFIEC CDR Call Schedule RC 03312025.txt", b"a" * 5000), ("FFIEC CDR Call Schedule RI 03312025.txt", b"b"), ("other.txt", b"z")):
        (tmp_path / name).write_bytes(body)
    got = {r["schedule_code"]: r for r in listing.scan_large_files(spark, str(tmp_path), leaf=1024, split=2048).collect()}
    assert {k: (r["file_size"], r["file_hash"]) for k, r in got.items()} == {
        "RC": (5000, plain_root(b"a" * 5000, 1024, byte_ranges.FANOUT)), "RI": (1, plain_root(b"b", 1024, byte_ranges.FANOUT)),
    }
    assert set(got["RC"].asDict()) == set(listing.scan_directory(spark, str(tmp_path)).columns)


def test_first_lines(spark, tmp_path, monkeypatch):
    heads = {"a.txt": b"IDRSSD\tRCON1\r\n1\t2\n", "b.txt": b"", "c.txt": b"\nx", "d.txt": b"only", "e.txt": b"\xef\xbb\xbfh\xc3\xa9\rnext", "f.txt": b"w" * 200_000 + b"\nrest"}
    for name, body in heads.items():
        (tmp_path / name).write_bytes(body)
    paths = [f"file:{tmp_path}/{n}" for n in [*heads, "gone.txt"]]
    got = {r["path"].rsplit("/", 1)[1]: r["header"] for r in byte_ranges.first_lines(spark, paths).collect()}
    assert got == {"a.txt": "IDRSSD\tRCON1", "c.txt": "", "d.txt": "only", "e.txt": "hé", "f.txt": "w" * 200_000}
    groups = schedules.group_by_header(spark, [("RC", p) for p in paths])
    assert groups[("RC", ("IDRSSD", "RCON1"))] == [paths[0]] and groups[("RC", ())] == [paths[1], paths[6]]
    # A file's size does not matter: only its first blocks are read.
    reads, reader = [], byte_ranges.FirstLineReader({"paths": "[]"})
    big = io.BytesIO(b"head\n" + b"x" * 5_000_000)
    monkeypatch.setattr(byte_ranges, "opened", lambda _: type("F", (), {"__enter__": lambda s: s, "__exit__": lambda *a: None, "read": lambda s, n: reads.append(n) or big.read(n)})())
    assert list(reader.read(byte_ranges.Listed(["p"]))) == [("p", "head")] and sum(reads) == byte_ranges.BLOCK


def csv_rows(content, sep):
    text = content.replace("\r\n", "\n")
    return [row or [""] for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep)]


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_quoted_records(spark, block):
    """Against the csv reader, for any block size; rows without id and repeated rows are texts of their own."""
    rng, docs = random.Random(block), []
    for i in range(12):
        sep = "\t|,"[i % 3]
        rows = []
        for _ in range(rng.randint(1, 30)):
            cells = ["".join(rng.choices(["a", "é", '"', "\n", sep, " "], k=rng.randint(0, 6))) for _ in range(rng.randint(2, 4))]
            rows.append([rng.choice("xyz"), *cells])
        out = io.StringIO()
        csv.writer(out, delimiter=sep, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
        docs.append((None if i % 4 == 0 else i // 2, out.getvalue()[: None if i % 2 else -1], sep))
    docs += [docs[3], (90, None, ","), (91, "", ","), (92, 'a,"never closed\nb,c\n', ",")]
    table = spark.createDataFrame([(i, c, 7) for i, c, _ in docs], "doc_id long, content string, record long")
    got = records.delimited_records(table, block_chars=block).collect()
    expected = []
    for i, content, sep in docs[:-3]:
        expected += [(i, n, cells) for n, cells in enumerate(csv_rows(content, sep))]
    expected.append((92, 0, ["a", '"never closed\nb', "c\n"]))
    key = lambda r: repr(tuple(r))
    assert sorted(((r["doc_id"], r["record_no"], r["cells"]) for r in got), key=key) == sorted(expected, key=key)


def plain_spans(rows):
    """Cells (text, colspan, rowspan) put into places row by row; covered places by a set."""
    covered, placed, width = {}, [], 0
    for y, row in enumerate(rows):
        x = 0
        for value, across, down in row:
            while covered.get((x, y)):
                x += 1
            down = min(down or len(rows) - y, len(rows) - y)
            placed.append((y, x, across, down, value))
            for dy in range(down):
                for dx in range(across):
                    covered[x + dx, y + dy] = True
            x += across
            width = max(width, x)
    grid = [[""] * width for _ in rows]
    for y, x, _, _, value in placed:
        grid[y][x] = value
    return grid, [p for p in placed if p[2] > 1 or p[3] > 1]


def test_spans_against_plain_places(spark):
    rng, docs, grids, merged = random.Random(5), [], {}, []
    for i in range(60):
        rows = [[(f"c{i}x{y}x{x}", rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 4, 0])) for x in range(rng.randint(0, 4))] for y in range(rng.randint(1, 6))]
        html = "<table>" + "".join("<tr>" + "".join(f'<td colspan="{a}" rowspan={d}>{v}</td>' for v, a, d in row) + "</tr>" for row in rows) + "</table>"
        docs.append((i, html))
        grids[i], spans = plain_spans(rows)
        merged += [(i, *s) for s in spans]
    tables = documents.html_tables(spark.createDataFrame(docs, "doc_id long, html string"))
    got = {r["doc_id"]: r["cells"] for r in documents.table_grids(tables).collect()}
    assert got == grids
    found = documents.merged_cells(tables).select("doc_id", "row_ix", "col_ix", "colspan", "rowspan", "value").collect()
    assert sorted(tuple(r) for r in found) == sorted(merged)


def test_spans_are_bounded(spark):
    html = '<table><tr><td colspan="1000000000">wide</td></tr><tr><td colspan=0 rowspan="99999999999999">a</td><td>b</td></tr></table>'
    tables = documents.html_tables(spark.createDataFrame([(None, html), (None, html)], "doc_id long, html string"))
    grids = documents.table_grids(tables).collect()
    assert [(g["n_rows"], g["n_cols"], g["table_ix"], g["cells"][1][:3]) for g in grids] == [(2, 1000, 0, ["a", "b", ""])] * 2
    assert [(r["row_ix"], r["colspan"], r["rowspan"]) for r in documents.merged_cells(tables).collect()] == [(0, 1000, 1)] * 2


def test_ranks_and_statistics_of_any_group(spark):
    rng = random.Random(7)
    rows = [(g, float(rng.choice([0, 0, 1, rng.randint(0, 40), -0.0]))) for g in "aab" * 200] + [("c", 5.0)]
    table = spark.createDataFrame(rows, "g string, value double")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = sorted((r["g"], r["value"], round(r["percentile"], 9)) for r in ranks.percentile_ranks(table, ["g"]).collect())
        chosen = spark.createDataFrame([("a", 1.0), ("b", 40.0)], "g string, own double")
        found = {r["g"]: r for r in ranks.statistics(ranks.value_counts(table, ["g"]), ["g"], chosen).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    of = {g: [v for h, v in rows if h == g] for g in "abc"}
    assert got == sorted((g, v, round(100 * sum(w <= v for w in of[g]) / len(of[g]), 9)) for g, v in rows)
    for g, own in (("a", 1.0), ("b", 40.0), ("c", None)):
        r, values = found[g], of[g]
        assert (r["size"], r["median"]) == (len(values), statistics.median(values))
        assert abs(r["mean"] - statistics.fmean(values)) < 1e-9 and abs(r["std_dev"] - statistics.pstdev(values)) < 1e-9
        assert own is None or abs(r["percentile"] - 100 * sum(v <= own for v in values) / len(values)) < 1e-9


def test_large_groups_are_numbered_as_small_ones(spark):
    rng = random.Random(2)
    rows = [(g, f"i{rng.randint(0, 80)}", s) for g in (0, 1) for s in range(120)]
    members = spark.createDataFrame(rows, "peer_group int, rssd_id string, seq int")
    columns = ("peer_group", "rssd_id", "ordinal", "set_size")
    assert sorted(map(tuple, compare.large_peer_groups(members).select(*columns).collect())) == sorted(map(tuple, compare.peer_groups(members).select(*columns).collect()))
    assert compare.large_peer_groups(members.filter(F.lit(False))).collect() == []
