import itertools

from ledgerloom.llm import warc

SCHEMA = "page_id long, url string, html string, slot string, hash string, node int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "s", "h", 1) for r in rows], SCHEMA)


def test_records_concatenate_to_files(spark):
    rows = [(5, "u5", "body"), (1, "u1", "é" * 10), (1, "u0", "tie"), (4096, "u", ""), (None, None, None), (7, "u7", None), (7, "u7", None)]
    got = warc.records(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r["file"], r["offset"])), key=lambda r: r["file"]):
        at = 0
        for r in group:
            raw = r["record"].encode()
            assert r["offset"] == at and r["length"] == len(raw)
            head, body = raw.split(b"\r\n\r\n", 1)
            assert f"Content-Length: {len(body) - 4}".encode() in head
            at += len(raw)


def found(recs, replica):
    got = warc.audit(recs, replica)
    return sorted(((r["page_id"], r["damage"]) for r in got.collect()), key=repr)


def in_place(spark, recs, change=(), lose=(), move=(), more=()):
    """The replica of ``recs`` with damage by page id; all else is where it was."""
    rows = []
    for r in recs.collect():
        r = r.asDict()
        if r["page_id"] in change:
            r["hash"] = "other"
        if r["page_id"] in move:
            r["offset"] += 1
        if r["page_id"] not in lose:
            rows.append(r)
    rows += [{**rows[0], "file": i // warc.FILE_IDS, "slot": i % warc.FILE_IDS, "page_id": i, "hash": "more", "seq": 9} for i in more]
    return spark.createDataFrame(rows, recs.schema)


def test_audit_locates_damage(spark):
    recs = warc.records(pages(spark, [(i, f"u{i}", f"page {i}") for i in range(0, 9000, 7)] + [(None, "n", "n"), (None, "m", "m"), (-3, "neg", "x"), (7, "u7", "twin")]))
    b = in_place(spark, recs, (21, 8400, None), (14, 700), (35, -3), (20, 7))
    assert found(recs, b) == sorted([(14, "missing"), (700, "missing"), (21, "altered"), (8400, "altered"), (None, "altered"), (None, "altered"), (20, "extra"), (7, "extra"), (35, "moved"), (-3, "moved")], key=repr)


def test_audit_sees_shifted_offsets(spark):
    recs = warc.records(pages(spark, [(i, "u", "h") for i in range(40)]))
    shifted = recs.withColumn("offset", recs["offset"] + 1000)
    assert found(recs, shifted) == sorted(((i, "moved") for i in range(40)), key=repr)
    # without a record, those behind it in the file lie elsewhere
    packed = warc.records(pages(spark, [(i, "u", "h") for i in range(40) if i != 30]))
    assert found(recs, packed) == sorted([(30, "missing"), *((i, "moved") for i in range(31, 40))], key=repr)


def test_many_records_of_one_slot_and_long_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 3)
    rows = [(5, f"u{k}", "x") for k in range(20)] + [(6, "long", "long " * 300_000)]
    recs = warc.records(pages(spark, rows))
    assert found(recs, recs) == []
    assert found(recs, warc.records(pages(spark, [(i, u, h if u != "u13" else "y") for i, u, h in rows]))) == [(5, "altered")]
    last = recs.where("seq = 19 OR page_id = 6")
    assert found(recs, recs.join(last, ["page_id", "seq"], "left_anti").select(recs.columns)) == [(5, "missing"), (6, "missing")]


def test_only_named_branches_are_joined(spark, monkeypatch):
    recs = warc.records(pages(spark, [(i, f"u{i}", "h") for i in range(0, 3000, 3)]))
    bad = in_place(spark, recs, change=set(range(0, 3000, 30)))
    want = found(recs, bad)
    assert len(want) == 100
    monkeypatch.setattr(warc, "NAMED_PARENTS", 2)
    assert found(recs, bad) == want


def test_equal_and_empty(spark):
    rows = [(1, "u", "h"), (1, "u", "h"), (2, "v", None)]
    recs, none = warc.records(pages(spark, rows)), warc.records(pages(spark, []))
    assert found(recs, warc.records(pages(spark, list(reversed(rows))))) == []
    assert found(none, none) == []
    assert found(recs, none) == [(1, "missing"), (2, "missing")]
    one, two = warc.pair(recs, warc.records(pages(spark, [(1, "u", "h"), (1, "u", "h"), (2, "v", "")])))
    assert one.root == two.root  # a null body is an empty one
