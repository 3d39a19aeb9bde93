"""Archives, url filter, fingerprints and search against brute force."""

import gzip
import hashlib

import numpy as np
import pytest
from fixtures import documents, rows_of, texts, words
from pyspark.sql import functions as F

from pairlens.llm import archives, merkle, pivots, urls
from pairlens.llm.queries import RULES
from pairlens.session import scratch_path

PAGES = "page_id bigint, url string, html string"


def pages():
    same = f"<p>{words(1, 40)}</p>"
    return [(3, "http://a.org/x y\n", same), (1, "http://b.org/", same), (7, None, same), (4, "", None), (5, "u", ""), (6, "http://c.d/é", "short"), (8, "http://c.d/", "short"), (9, "x://y", "WARC/1.1\r\n\r\nHTTP/1.1 200\r\n\r\n" * 9), (10, "x://z", words(2, 20000)), (1, "http://b.org/", same), (None, "n", same)]


@pytest.mark.parametrize("extra", [False, True])
def test_archive_round_trip(spark, extra):
    df = spark.createDataFrame(pages(), PAGES).repartition(3)
    if extra:
        df = df.withColumns({c: F.lit("?") for c in ("value", "first", "file", "at", "payload", "record_type", "content", "path")})
    got = rows_of(archives.archive_round_trip(df), "page_id", "payload_bytes", "payload_digest", "refers_to")
    want, first = [], {}
    for page, _, html in pages():
        digest = hashlib.sha256((html or "").encode()).hexdigest()
        if page is not None:
            first[digest] = min(page, first.get(digest, page))
    seen = set()
    for page, _, html in sorted(pages(), key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        refers = first[digest] if len(data) >= 100 and digest in seen else None
        seen.add(digest)
        want.append((page, len(data), digest, refers))
    assert got == sorted(want, key=repr)
    assert archives.archive_round_trip(df.limit(0)).count() == 0


def test_both_versions_and_lengths():
    body = b"line\n\nhttp://not.a.header 1 2 3 4\n"
    for version, line in ((1, b"http://a.b/c d 1.2.3.4 19990101000000 text/html %d"), (2, b"http://a.b/c d 1.2.3.4 19990101000000 text/html 200 - - 0 f.arc %d")):
        block = f"{version} 0 x\n{archives.FIELDS[version]}\n".encode()
        data = b"filedesc://f 0.0.0.0 19990101000000 text/plain %d\n" % len(block) + block + b"\n" + line % len(body) + b"\n" + body + b"\n" + line % 0 + b"\n\n"
        for raw in (data, gzip.compress(data), gzip.compress(data[:90]) + gzip.compress(data[90:])):
            records = list(archives.read_arc(raw))
            assert [r[:2] for r in records] == [(version, 0), (version, 1), (version, 2)]
            assert records[1][2]["URL"] == "http://a.b/c d" and records[1][3] == body and records[2][3] == b""
        with pytest.raises(ValueError, match="ends within"):
            list(archives.read_arc(data + line % 999 + b"\nx"))


def test_warc_records_are_whole(spark):
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    archives.write_arc(spark.createDataFrame(pages(), PAGES).coalesce(1), arc)
    assert archives.arc_records(spark, arc).count() == len(pages())
    archives.convert(spark, arc, warc)
    out = archives.read_warcs(spark, warc).collect()
    assert len(out) == len({r["record_id"] for r in out}) == len(pages())
    by_id = {r["record_id"]: r for r in out}
    for r in out:
        if r["record_type"] == "revisit":
            target = by_id[r["refers_to_id"]]
            assert target["record_type"] == "response" and target["payload_digest"] == r["payload_digest"]
    assert {r["warc_date"] for r in out if r["page_id"] == 10} == {"2000-01-01T00:00:10Z"}


def test_members_can_be_read_by_offset_and_ids_repeat(spark):
    """Each record is a gzip member; the archive's name and the record's number make its id, whatever the folder."""
    import zlib

    ids = []
    for _ in range(2):
        arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
        archives.write_arc(spark.createDataFrame(pages(), PAGES).coalesce(1), arc)
        archives.convert(spark, arc, warc)
        data = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(warc).where("length > 0").first()["content"])
        records = []
        while data:
            codec = zlib.decompressobj(31)
            one = codec.decompress(data)
            assert codec.eof
            data = codec.unused_data
            if one:
                records += [(head, block) for head, block in archives.read_warc(one)]
        kinds = [head["WARC-Type"] for head, _ in records]
        assert kinds.count("warcinfo") == 1 == kinds[:1].count("warcinfo") and len(records) == len(pages()) + 1
        assert b"source-format: ARC version 1" in records[0][1]
        assert {head["WARC-Warcinfo-ID"] for head, _ in records[1:]} == {records[0][0]["WARC-Record-ID"]}
        ids.append(sorted(head["WARC-Record-ID"] for head, _ in records))
    assert ids[0] == ids[1]


def slow_ratio(train, url):
    """Witten-Bell by recursion."""

    def chance(model, context, char):
        if context is None:
            return 1 / 256
        lower = chance(model, context[1:] if context else None, char)
        seen = model.get(context)
        if not seen:
            return lower
        n, t = sum(seen.values()), len(seen)
        return (seen.get(char, 0) + t * lower) / (n + t)

    models = []
    for group in train:
        model = {}
        for u, n in group:
            s = "\u0001" * urls.ORDER + u + "\u0002"
            for i in range(urls.ORDER, len(s)):
                for k in range(urls.ORDER + 1):
                    seen = model.setdefault(s[i - k : i], {})
                    seen[s[i]] = seen.get(s[i], 0) + n
        models.append(model)
    s = "\u0001" * urls.ORDER + url + "\u0002"
    return float(np.mean([np.log(chance(models[0], s[i - urls.ORDER : i], s[i])) - np.log(chance(models[1], s[i - urls.ORDER : i], s[i])) for i in range(urls.ORDER, len(s))]))


def test_url_filter_matches_recursion(spark):
    rng = np.random.default_rng(2)
    cases = [None, "", "no scheme", "http://EXAMPLE.org/es/x?y#z", "https://a.example.org/en/12", "http://example.org/en/21", "x://fr.com/fr/", "http://com/de/q", "http://com", "http://notorg/", "http://a.org?x=/es/", "http://a.b.com/fr/1#://x.org/", "://org/", "http://ex.com/é😀/" + "a" * 3000]
    cases += [f"http://w{rng.integers(9)}.{rng.choice(['example.org', 'b.com', 'c.net'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.integers(300)}" for _ in range(200)] + ["http://hot.com/fr/1"] * 100
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id bigint, url string").withColumns({"host": F.lit(1), "score": F.lit(1), "n": F.lit(1), "rule": F.lit(1)})
    got = {r["page_id"]: r for r in urls.filter_urls(df, RULES).collect()}
    assert len(got) == len(cases)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(13)] == [
        ("", "", None), ("", "", None), ("", "", None), ("example.org", "/es/x", "example.org/es/"), ("a.example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/21", "org/"), ("fr.com", "/fr/", "com/fr/"),
        ("com", "/de/q", "com/de/"), ("com", "", None), ("notorg", "/", None), ("a.org", "", None), ("a.b.com", "/fr/1", "com/fr/"), ("org", "/", "org/"),
    ]
    ruled = {}
    for i, u in enumerate(cases):
        if got[i]["rule"]:
            key = (u, got[i]["verdict"])
            ruled[key] = ruled.get(key, 0) + 1
    held = {u for u, _ in ruled if int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % urls.HELD_OUT == 0}
    train = [[(u, n) for (u, v), n in ruled.items() if v == verdict and u not in held] for verdict in ("allow", "block")]
    for i in (0, 2, 8, 20, 57):
        assert got[i]["score"] == pytest.approx(slow_ratio(train, cases[i] or ""), abs=1e-6)
    assert urls.filter_urls(df.limit(0), RULES).count() == 0


def test_url_filter_sends_no_table_through_the_driver(spark):
    """A row per character of each url: small as a compressed file, far too large for the driver to collect and send to all tasks."""
    cases = [f"http://w{i % 9}.{['example.org', 'b.com', 'c.net'][i % 3]}/{['en', 'es', 'fr', 'de'][i % 4]}/{i}" for i in range(3000)]
    cases += [None, "", "http://hot.com/fr/1", "http://hot.com/fr/1"]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string")
    got = {}
    for broadcast, most in (("-1", "8g"), ("10m", "1")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        spark.conf.set("spark.sql.maxBroadcastTableSize", most)
        try:
            got[broadcast] = {r["page_id"]: (r[1:5], r["score"]) for r in urls.filter_urls(df, RULES).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(got["10m"]) == len(cases)
    assert all(own == want and score == pytest.approx(wanted, abs=1e-8) for (own, score), (want, wanted) in ((got["10m"][i], got["-1"][i]) for i in range(len(cases))))


@pytest.mark.parametrize("extra", [False, True])
def test_fingerprints_of_edits(spark, extra):
    out = merkle.fingerprints_of_edits(documents(spark, extra=extra)).collect()
    order = sorted(((d, t or "") for d, t in texts()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"]) for r in out) == sorted((d is not None, d or 0, len(t)) for d, t in order)
    by_id = {r["doc_id"]: r for r in out}
    single = [i for i, (d, _) in enumerate(order) if sum(d == x for x, _ in order) == 1]
    for i in single:
        d, t = order[i]
        following = [x for x, _ in order[i + 1 :]][:1]
        if following and following[0] is not None and sum(following[0] == x for x, _ in order) > 1:
            continue  # several rows of the next id: a hash decides
        if i + 1 == len(order):
            continue  # the first rows have a null id, two of them
        n = len(t) // 4
        edited = t[: len(t) - n] + order[i + 1][1][:n]
        assert by_id[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    alike = {}
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    for r, t in ((by_id[d], t) for d, t in (order[i] for i in single)):
        alike.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in alike.values()) and len({x for v in alike.values() for x in v}) == len(alike)
    assert by_id[15]["near_edited"] > 0.7 and by_id[15]["near_next"] < 0.1
    assert merkle.fingerprints_of_edits(documents(spark, [])).count() == 0
    one = merkle.fingerprints_of_edits(documents(spark, [(1, "ab cd efg")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"ab cd eab").hexdigest()


def test_branches_locate_the_edit(spark):
    lines = [words(i, 8) for i in range(60)]
    other = list(lines)
    other[17], other[40] = "changed", "too"
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    pa, pb = merkle.paragraphs(F.col("a")), merkle.paragraphs(F.col("b"))
    assert df.select(merkle.edited_paragraphs(pa, pb)).first()[0] == [17, 40]
    assert df.select(F.size(merkle.sections(pa))).first()[0] > 5
    both = merkle.tree(df.select(F.explode(F.array("a", "b", "a")).alias("text"))).collect()
    assert both[0]["root"] == both[2]["root"] != both[1]["root"]


def test_edited_paragraphs_of_many_lines(spark):
    rng = np.random.default_rng(5)
    own = [f"line {i}, clause {rng.integers(9)}" for i in range(3000)]
    own[100:200] = ["the same"] * 100
    own[7] = own[2500] = ""
    other = [x for i, x in enumerate(own) if i % 5 and i > 300] + ["new"] * 3
    cases = [(own, other), (own, own), (own, ["x"]), (["a", "b", "a"], ["b"]), ([""], [""]), ([""], ["a"])]
    df = spark.createDataFrame([(i, "\n".join(a), "\n".join(b)) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    out = df.select("i", merkle.edited_paragraphs(merkle.paragraphs(F.col("a")), merkle.paragraphs(F.col("b"))).alias("at")).collect()
    assert {r["i"]: r["at"] for r in out} == {i: [k for k, line in enumerate(a) if line not in set(b)] for i, (a, b) in enumerate(cases)}


def test_edits_keep_the_leaves_of_whole_lines(spark):
    rows = [(i, "\n".join(words(100 * i + k, 5) for k in range(i % 7))) for i in range(40)]
    got = {r["doc_id"]: r for r in merkle.fingerprints_of_edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    edited = []
    for i, t in rows:
        n = len(t) // 4
        edited.append((i, t[: len(t) - n] + rows[(i + 1) % len(rows)][1][:n]))
    fresh = {r["doc_id"]: r["fingerprint"] for r in merkle.tree(spark.createDataFrame(edited, "doc_id bigint, text string")).collect()}
    assert {i: r["edited_fingerprint"] for i, r in got.items()} == fresh


def test_search_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 64)
    monkeypatch.setattr(pivots, "STEPS", (16, 256))
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 12)]) for i in range(1500)]
    vectors += [(i, vectors[100][1]) for i in range(2000, 2700)]  # one frequent vector
    vectors += [(5000, None), (5001, [1.0, None]), (5002, [float("nan")]), (5003, [float("inf")] * 12), (5004, [0.5, 0.25]), (None, [1.0] * 12), (5100, [1e6] * 12), (7, [9.0] * 12)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumns({"vec": F.lit(1), "cell": F.lit(2), "dist": F.lit(3)})
    got = {}
    for r in pivots.top_k(df, F.col("vec_id") % 100 == 0, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    rows = []
    for i, v in vectors:
        if i is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        own = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
        rows.append((i, np.array(own + [0] * (12 - len(own)), dtype=object)))
    asked = [(i, v) for i, v in rows if i % 100 == 0]
    assert set(got) == {i for i, _ in asked}
    for i, v in asked:
        best = sorted((-int((v * w).sum()), j) for j, w in rows if j != i)[:10]
        assert sorted(got[i]) == [(k + 1, -s, j) for k, (s, j) in enumerate(best)]
    assert pivots.top_k(df.limit(0), F.lit(True)).count() == 0
    assert pivots.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
