"""Leaks, hosts, archives, mixing and the pipeline on small fixtures, against plain Python."""

import hashlib
import math
import re
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from strataweave.llm import host_reputation, mixing, template_leaks, warc_zstd
from strataweave.llm.queries import URL_RULES
from strataweave.scratch import shared_root

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "A train leaves Boston at 60 km and returns to Boston after 3 hours and 60 more stops along the old track."


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def leaked(spark, rows, items):
    frame = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r["items"] for r in template_leaks.judge(docs(spark, rows), frame).collect()}


def test_leaks_with_other_numbers_and_names(spark):
    other = ITEM.replace("60", "75").replace("Boston", "Denver").replace("3", "9")
    torn = ITEM.replace("at 60", "at 75").replace("to Boston", "to Denver")  # one value, two replacements
    rows = [
        (1, ITEM), (2, f"Some words before. {other} And after."), (3, torn), (4, "Nothing of the kind is said in here at all."),
        (5, " ".join(ITEM.split()[:8])), (6, None), (7, ""), (8, "1 2 3 4 5 6 7 8 9 10 11 12 13"),
        (None, ITEM.upper().lower()), (9, ("pad " * 30000) + ITEM), (9, "repeated id"),
    ]
    found = leaked(spark, rows, [(1, ITEM), (2, None), (3, ""), (4, "5 6 7 8 9 1 2 3"), (None, ITEM), (5, ITEM)])
    assert found[1] == [1, 5] and found[2] == [1, 5] and found[9] == [1, 5]
    assert found[4] == found[5] == found[6] == found[7] == []
    assert 1 not in found[3] and 4 in found[8]  # numbers replaced one to one


def plain_leaks(text, item, n=5, share=0.8):
    """Whether an item with numbers only leaks: agreeing alignments found by trying all subsets of them."""
    import itertools

    def token(w):
        return "<num>" if w[0].isdigit() else w

    a, b = text.split(), item.split()
    windows = {tuple(map(token, b[i : i + n])) for i in range(len(b) - n + 1)}
    shifts = {}
    for i in range(len(a) - n + 1):
        for j in range(len(b) - n + 1):
            if list(map(token, a[i : i + n])) == list(map(token, b[j : j + n])):
                pairs = {(b[j + x], a[i + x]) for x in range(n) if token(b[j + x]) == "<num>"}
                found = shifts.setdefault(i - j, (set(), set()))
                found[0].add(tuple(map(token, b[j : j + n])))
                found[1].update(pairs)
    good = [f for f in shifts.values() if len({x for x, _ in f[1]}) == len(f[1])]
    best = 0
    for k in range(1, min(len(good), 4) + 1):
        for some in itertools.combinations(good, k):
            pairs = set().union(*(p for _, p in some))
            if len({x for x, _ in pairs}) == len(pairs):
                best = max(best, len(set().union(*(w for w, _ in some))))
    return best >= share * len(windows)


def test_alignments_of_a_leak_must_agree(spark):
    head = "the train leaves town at 60 and runs for 3 full hours along the river until"
    tail = "it has passed 60 bridges and 3 long tunnels before the last station comes up"
    item = f"{head} {tail}"
    new = lambda text, a, b: " ".join({"60": a, "3": b}.get(w, w) for w in text.split())
    texts = [
        item, new(item, "75", "8"), new(head, "75", "8") + " " + new(tail, "99", "8"),
        new(head, "75", "8") + " " + new(tail, "75", "5"), new(head, "75", "8") + " far away " + new(tail, "75", "8"),
        new(head, "75", "8") + " far away " + new(tail, "99", "8"), new(head, "75", "8") + " far away " + new(tail, "99", "1"),
        new(head, "75", "75") + " then " + new(tail, "75", "75"), f"{item} and again {new(item, '1', '2')}",
        f"{new(head, '1', '2')} x {new(tail, '3', '4')} y {new(head, '3', '4')}", head, f"{head} {head}",
    ]
    found = leaked(spark, list(enumerate(texts)), [(1, item)])
    wanted = [plain_leaks(t, item) for t in texts]
    assert [bool(found[i]) for i in range(len(texts))] == wanted
    assert wanted[4] and not wanted[2] and not wanted[5]


def test_templates(spark):
    text = "In 1990 Anna paid $5 for 3 kg. Bob, and Éva (who) left."
    frame = template_leaks.tokenized(spark.createDataFrame([(1, text)], "k int, text string"), "k")
    got = frame.select(template_leaks.template().alias("x")).first().x
    assert got == "in <num> <name> paid <num> for <num> <unit> bob and <name> who left".split()


def test_leaks_match_plain_windows(spark):
    """Without numbers and names a leak is 80 % of the item's five-word windows."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")

    def grams(text):
        w = [x.lower().strip(template_leaks.PUNCTUATION) for x in (text or "").split()]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    asked = {r.item_id: grams(r.text) for r in items.collect()}
    want = {}
    for r in table.select("doc_id", "text").collect():
        mine = grams(r.text)
        want[r.doc_id] = {i for i, g in asked.items() if g and len(g & mine) >= 0.8 * len(g)}
    got = {r.doc_id: set(r["items"]) for r in template_leaks.judge(table, items).collect()}
    assert sum(map(bool, want.values())) > 5
    assert got == want


def test_drop_leaks_keeps_columns(spark):
    frame = docs(spark, [(1, ITEM), (2, "clean"), (None, ITEM), (2, "clean")]).withColumn("item_id", F.lit(1))
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    left = template_leaks.drop_leaks(frame, items)
    assert left.columns == frame.columns and [r.doc_id for r in left.collect()] == [2, 2]
    assert template_leaks.drop_leaks(frame, items.limit(0)).count() == 4
    assert template_leaks.judge(frame.limit(0), items).collect() == []


def test_leaks_with_names_that_start_sentences(spark):
    item = "Alice has 3 apples in her bag. Alice gives 2 apples to Tom. Alice then eats one more apple today."
    other = item.replace("Alice", "Bob").replace("3", "7")
    mixed = "Bob".join(item.split("Alice", 1)).replace(". Alice gives", ". Carol gives").replace(". Alice then", ". Dan then")
    short = "Which river is longest"
    rows = [(1, item), (2, other), (3, f"1) Question, {item}"), (4, mixed), (5, item.lower()),
            (6, f"see: {short} of all"), (7, "which river is short"), (8, "There are 42 of them in Rome"), (9, "it has 43 of them")]
    found = leaked(spark, rows, [(1, item), (2, short), (3, "42"), (4, "the train leaves at nine"), (5, "Rome")])
    assert found[1] == found[2] == found[3] == [1]
    assert found[4] == [] and found[6] == [2] and found[7] == [] and found[8] == [3, 5] and found[9] == []
    assert leaked(spark, [(1, "My heading The train leaves at nine")], [(1, "the train leaves at nine")]) == {1: [1]}


def test_leaks_of_rows_without_an_id(spark):
    """Rows are compared on their own, whatever their ids: no slots torn by others, no windows added up."""
    words = ITEM.split()
    other = ITEM.replace("60", "75").replace("Boston", "Denver")
    halves = [" ".join(words[:12]), " ".join(words[8:])]
    rows = [(None, ITEM), (None, other), (None, "clean"), *[(None, t) for t in halves], *[(7, t) for t in halves]]
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = template_leaks.judge(docs(spark, rows), items).collect()
    assert sorted((str(r.doc_id), r.contaminated) for r in got) == [("7", False)] * 2 + [("None", False)] * 3 + [("None", True)] * 2
    left = template_leaks.drop_leaks(docs(spark, [*rows, (7, ITEM)]).withColumn("row", F.lit(1)), items)
    assert left.columns[-1] == "row"
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted((str(i), t) for i, t in rows[2:])


def test_urls(spark):
    rows = [
        (1, "https://WWW.Example.NET/en/1?q#f"), (2, "http://example.net/de/"), (3, "http://a.example.com/de/x"),
        (4, "ftp://x.org/fr/"), (5, "http://x.org"), (6, None), (7, "no scheme"), (8, "http://net"), (9, "http://ne.xnet/"),
        (10, "a://b://c/d"), (11, "http://É.org/FR/"), (12, ""), (None, "http://bad.org/1"), (13, "http://bad.org/2"), (13, "http://bad.org/2"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("mine"))
    outcomes = spark.createDataFrame(
        [("http://bad.org/", 1)] * 60 + [("http://good.org/", 0)] * 60 + [("http://x.com/", 0)] * 20 + [("http://few.org/", 1), (None, 1), ("http://bad.org/", None)],
        "url string, bad int",
    )
    got = host_reputation.judge_urls(pages, outcomes, URL_RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert (by[2].rule, by[2].verdict) == ("net/", "block") and (by[3].rule, by[3].verdict) == ("example.com/de/", "block")
    assert (by[4].rule, by[4].verdict) == ("org/fr/", "allow") and by[5].rule is None and by[8].rule is None and by[9].rule is None
    assert all((by[i].host, by[i].path) == ("", "") for i in (6, 7, 12))
    assert (by[10].host, by[10].path) == ("b:", "//c/d") and (by[11].host, by[11].path, by[11].rule) == ("É.org", "/FR/", None)
    assert by[13].verdict == "block" and by[None].verdict == "block" and by[5].verdict == "allow"
    assert by[13].bad_bound < by[13].bad_rate < 1
    none = host_reputation.judge_urls(pages, outcomes.limit(0), URL_RULES).collect()
    assert {r.verdict for r in none if r.rule is None} == {"allow"}
    assert host_reputation.judge_urls(pages.limit(0), outcomes, URL_RULES).collect() == []


def test_few_pages_do_not_block(spark):
    outcomes = spark.createDataFrame([("http://a.org/", 1), ("http://b.org/", 0)] + [("http://c.org/", 0)] * 40, "url string, bad int")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert host_reputation.judge_urls(pages, outcomes, []).first().verdict == "allow"


def page_rows():
    big, other = "é" * 600, "x" * 1000
    return [
        (1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "u\r\nEvil: 1", other), (5, "u", "small"), (6, "u", "small"),
        (7, "u", None), (8, "u", ""), (9, "u", "y" * 999), (10, "u", "y" * 999), (None, "u", other), (11, "u", "z" * 3_000_000), (3, "u", big),
    ]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), "id long, url string, html string").repartition(2)
    rows = pages.select("id", "url", F.col("html").cast("binary").alias("payload"))
    got = warc_zstd.round_trip(rows).collect()
    assert len(got) == len(page_rows()) and all(r.error is None for r in got)
    want = []
    for i, _, t in page_rows():
        payload = (t or "").encode()
        same = [j for j, _, u in page_rows() if (u or "").encode() == payload]
        owner = max((j for j in same if j is not None), default=None)
        refers = owner if len(payload) >= 1000 and len(same) > 1 and i != owner else None
        want.append((i, "response" if refers is None else "revisit", hashlib.sha1(payload).hexdigest(), len(payload), refers,
                     payload if refers is None else None))
    key = lambda r: tuple(map(str, r[:5]))
    found = [(r.id, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to,
              None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=key) == sorted(want, key=key)
    assert next(r.target_uri for r in got if r.id == 4) == "u%0D%0AEvil:%201"
    assert warc_zstd.round_trip(rows.limit(0)).collect() == []


def test_archives_with_dictionary_and_damage(spark):
    records = [warc_zstd.make_record(i, f"http://a/{i}", (f"<p>page {i} " * 40).encode(), hashlib.sha1((f"<p>page {i} " * 40).encode()).hexdigest(), None)
               for i in range(400)]
    dictionary = warc_zstd.make_dictionary(records)
    assert dictionary
    packed = zstandard.ZstdCompressor().compress(dictionary)
    compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    for body in (packed, dictionary):  # packed and plain
        data = struct.pack("<II", warc_zstd.SKIPPABLE, len(body)) + body + b"".join(compressor.compress(r) for r in records)
        read = list(warc_zstd.frames(memoryview(data)))
        assert [r for _, r, e in read] == records and all(e is None for *_, e in read)
        assert all(warc_zstd.parse_record(r)["error"] is None for _, r, _ in read)
        cut = list(warc_zstd.frames(memoryview(data[:-5])))
        assert len(cut) == 400 and cut[-1][2] and all(e is None for *_, e in cut[:-1])
    assert list(warc_zstd.frames(memoryview(data[: len(body) // 2])))[0][2] == "dictionary frame is cut short"
    assert list(warc_zstd.frames(memoryview(b"junkjunkjunk")))[0][2]
    good = records[0]
    assert warc_zstd.parse_record(good[:-1])["error"] == "length differs"
    assert warc_zstd.parse_record(good.replace(b"WARC-Date", b"WARC-Dote"))["error"] == "missing warc-date"
    assert warc_zstd.parse_record(good.replace(b"<p>page 0", b"<p>page 1", 1))["error"] == "payload digest differs"
    assert warc_zstd.parse_record(b"")["error"] and warc_zstd.parse_record(b"\r\n\r\n")["error"]
    # a damaged file is reported and does not stop the others
    folder = f"{shared_root(spark)}/warc-damage"
    import pathlib

    place = pathlib.Path(folder.removeprefix("file://"))
    place.mkdir()
    (place / "a.warc.zst").write_bytes(data[:-5])
    (place / "b.warc.zst").write_bytes(data)
    rows = warc_zstd.read_archives(spark, folder)
    assert rows.count() == 800 and rows.where("error IS NOT NULL").count() == 1


def test_archives_with_any_damage_are_told_not_raised():
    records = [warc_zstd.make_record(i, f"http://a/{i}", b"x" * 50 + b"%d" % i, hashlib.sha1(b"x" * 50 + b"%d" % i).hexdigest(), None) for i in range(300)]
    dictionary = warc_zstd.make_dictionary(records)
    packed = zstandard.ZstdCompressor().compress(dictionary)
    head = struct.pack("<II", warc_zstd.SKIPPABLE, len(packed))
    torn = bytearray(packed)
    torn[len(torn) // 2] ^= 0xFF
    for broken in (bytes(torn), packed[:4] + b"\xff" * 12 + packed[16:], b"\x37\xa4\x30\xec" + b"\0" * 20):
        got = list(warc_zstd.frames(memoryview(struct.pack("<II", warc_zstd.SKIPPABLE, len(broken)) + broken + b"abc")))
        assert got and got[-1][2]
    plain = zstandard.ZstdCompressor().compress(records[0])
    skip = struct.pack("<II", 0x184D2A51, 40) + b"z" * 40
    assert [e for _, _, e in warc_zstd.frames(memoryview(plain + skip + plain))] == [None, None]
    assert list(warc_zstd.frames(memoryview(plain + skip[:30])))[-1][2] == "frame: skippable frame is cut short"
    for wrong in ("²", "٣", "1" * 5000, "-5", "+5", "1_0", ""):
        text = re.sub(rb"\r\nContent-Length: [0-9]+\r\n\r\nHTTP", f"\r\nContent-Length: {wrong}\r\n\r\nHTTP".encode(), records[0], count=1)
        assert warc_zstd.parse_record(text)["error"] in ("length differs", "missing content-length")
    length = len(re.search(rb"(?s)HTTP/1.1.*", records[0])[0]) - 4
    for wrong in ("²".encode("latin-1"), b"9" * 5000):
        http = re.sub(rb"Content-Length: [0-9]+", b"Content-Length: " + wrong, re.search(rb"(?s)HTTP/1.1.*", records[0])[0], count=1)
        head_ = records[0].split(b"HTTP/1.1")[0].replace(b"Content-Length: %d" % length, b"Content-Length: %d" % (len(http) - 4))
        assert warc_zstd.parse_record(head_ + http)["error"] == "no HTTP length"
    random = __import__("random").Random(1)
    whole = head + packed + b"".join(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(r) for r in records[:5])
    for _ in range(300):  # any bytes may be wrong
        data = bytearray(whole)
        for _ in range(random.randrange(1, 4)):
            data[random.randrange(len(data))] = random.randrange(256)
        for _, record, error in warc_zstd.frames(memoryview(bytes(data))):
            if error is None:
                warc_zstd.parse_record(record)


def mixed(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, "en", s, 0) for i, s, t in rows], DOCS).withColumn("taken", F.lit("old"))
    return mixing.mix(frame, **options)


def test_mix(spark):
    rows = [(i, f"s{i % 4}" if i % 5 else None, "w " * (1 + i * 7 % 23)) for i in range(900)]
    rows += [(5000, "s0", None), (5001, "s0", ""), (None, "s1", "a b"), (5002, "zero", ""), (7, "s3", "w " * 8), (5003, "s2", "w " * 20000)]
    got = mixed(spark, rows).collect()
    assert len(got) == len(rows)
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}
    goal, capped = {}, set()
    while True:
        rate = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        goal = {s: 2 * size[s] if s in capped else rate * weight[s] for s in order}
        over = {s for s in order if goal[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, goal[r.source], rel_tol=1e-12)
        assert r.taken <= 2 * r["size"] and (r.taken == 0 if not r["size"] else r.taken % r["size"] == 0)
    for s in order:
        most = max(r["size"] for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) - goal[s]) <= max(most, 1)
    again = mixed(spark, rows[::-1]).collect()
    pick = lambda rs: sorted((str(r.doc_id), r.text or "", r.taken) for r in rs)
    assert pick(got) == pick(again)


def test_mix_edges(spark):
    assert mixed(spark, [(1, "a", "x")]).limit(0).collect() == []
    frame = spark.createDataFrame([], DOCS)
    assert mixing.mix(frame).collect() == []
    assert [(r.taken, r.target) for r in mixed(spark, [(1, "a", None), (2, None, "")]).collect()] == [(0, 0.0)] * 2
    only = mixed(spark, [(i, "a", "w w") for i in range(100)]).collect()
    assert sum(r.taken for r in only) == 300 and {r.target for r in only} == {300.0}


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """documents with planted cases, and the tables that the pipeline reads."""
    folder = tmp_path_factory.mktemp("tiny")
    clean = [f"{a} {b} story number word{a}{b} tells of {b} {a} things in its own way today and tomorrow id{i}"
             for i, (a, b) in enumerate((a, b) for a in "red blue green grey pink gold teal ruby".split()
                                       for b in "cat dog cow owl bee ant elk hen pig rat".split())]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, f"you awful idiot number {i} go away") for i in range(24)]
    rows += [(200, clean[3]), (201, clean[3])]  # exact copies
    long = " ".join(f"token{i}" for i in range(60))
    rows += [(300, long), (301, long + " end"), (302, "start " + long)]  # near copies
    rows += [(400, f"before {ITEM} after")]  # leak
    rows += [(500, None), (501, ""), (None, "a row without an id"), (0, clean[0])]
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 0) for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(80) if i != 3] + [(100 + i, 0, 1) for i in range(12)] + [(None, 0, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_pipeline_stage_by_stage(spark, tiny):
    folder, rows = tiny
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    ids, columns = [], frame.columns
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
        if name != "mixing":
            assert frame.columns == columns
        ids.append(sorted(str(r.doc_id) for r in frame.select("doc_id").collect()))
    of = lambda *gone: sorted(str(i) for i, _ in rows if i not in gone)
    toxic = [100 + i for i in range(24)]
    assert ids[0] == of(*toxic)
    kept = [i for i in ids[0] if i not in ("3", "200", "500")]  # the largest id of equal texts stays
    kept.remove("0")  # the repeated row
    assert ids[1] == kept
    assert ids[2] == [i for i in kept if i not in ("301", "302")]
    assert ids[3] == [i for i in ids[2] if i != "400"]
    assert set(ids[4]) <= set(ids[3]) and ids[4]


def test_pipeline_run(spark, tiny):
    folder, _ = tiny
    got = corpus_pipeline.run(spark, folder).collect()
    by_source = {}
    for r in got:
        t = by_source.setdefault(r.source, [0, r.target, 0])
        t[0] += r.taken
        t[2] = max(t[2], r["size"])
    assert got and all(abs(a - b) <= most for a, b, most in by_source.values())
    frame = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:  # empty tables pass
        frame = stage(spark, frame, folder)
        assert frame.collect() == []
