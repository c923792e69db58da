"""Operators on tables, pages and the pipeline."""

import random
import re
import statistics
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.compare import check, duck
from tests.llm import cases
from tests.llm.test_texts import near
from tidycell.llm import decontaminate, html_text, mixture, pii, quality, shard, url_filter
from tidycell.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, sf, con, name):
    assert check(spark, con, name, QUERIES[name], SQL[name], sf)[0] == "ok"


def test_quality_odd_rows(spark):
    docs = cases.documents(spark)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    # Too short, empty, null and repetitive ones go; a null id, a null source and a long text do not matter.
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 2, 3, 3, 7]
    assert quality.keep(docs.limit(0)).count() == 0


def test_hosts_are_judged_with_a_prior(spark):
    bad, good = "x # # # # y z u v w q r s", "plain words that are quite good enough to stay in here ok"
    rows = [(i, bad if i % 10 else good, "en", "spam", 1) for i in range(40)] + [(100 + i, good, "en", f"h{i % 8}", 1) for i in range(80)] + [(300, bad, "en", "h1", 1)]
    kept = {r.doc_id for r in quality.keep(spark.createDataFrame(rows, cases.DDL)).collect()}
    assert {0, 10, 20, 30} <= kept and 1 not in kept and 300 in kept and set(range(100, 180)) <= kept


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum((d * (1 + i % 2)) - 9 * (d * (1 + i % 2) > 9) for i, d in enumerate(map(int, reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_personal_data_against_plain_forms(spark, sf):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["1", "25", "4111 1111 1111 1111", ".", "@", "a.b", "-", " ", "+", "(", "x_y", "é", "\n", "\x01", "0.0.0.9"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += [None, "", "9" * 20_000, "a" * 20_000 + "@b.c", " ".join(f"{i}.1.2.3 m{i}@x.org" for i in range(2000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").selectExpr("doc_id + 10000", "text"))
    given = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.extract(docs).collect():
        assert r.base == ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in FORMS.items() for m in re.finditer(p, given[r.doc_id] or "") if valid(k, m.group()))
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    assert pii.extract(docs.limit(0)).count() == 0


def test_contexts_learned_from_seeds_find_other_identifiers(spark):
    rows = [(i, f"please call me at +49 30 555{i:04d} today") for i in range(12)] + [(50, "please call me at EXT-445566 soon"), (51, "version 2024.07 of it"), (52, "room EXT-445566")]
    found = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[50].spans == "context:18:28" and found[50].base == "" and found[51].n_context == 0 and found[52].n_context == 0


def test_contexts_shared_only_with_found_identifiers_are_learned(spark):
    """Phones lead to EMP-..., these to the badges, these to the lockers; rooms share nothing with them."""
    rows = [(i, f"please call me at +49 30 555{i:04d} today") for i in range(30)]
    rows += [(100 + i, f"please call me at EMP-10{i:03d} soon") for i in range(20)]
    rows += [(200 + i, f"badge no EMP-10{i:03d} lost") for i in range(20)] + [(300 + i, f"badge no EMP-70{i:03d} lost") for i in range(12)]
    rows += [(400 + i, f"locker of EMP-70{i:03d} open") for i in range(12)] + [(500, "locker of EMP-99999 open")] + [(600 + i, f"room with EXT-8000{i} shut") for i in range(8)]
    found = {r.doc_id: r.spans for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        m = re.search(r"EMP-\d+|\+[\d ]+\d", text)
        assert found[i] == (f"{'phone' if m[0][0] == '+' else 'context'}:{m.start()}:{m.end()}" if m else "")


def test_contexts_are_the_two_words_before_whatever_they_are(spark):
    texts = ["ids: A123456 B234567", "Room 12 EXT-445566 a.b@c.de,x.y@z.de", "mail " + "w" * 100 + " C345678", "D456789", "+49 30 5550001 E567890", " ".join(f"k{i}" for i in range(600))]
    found = pii.base(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    words = {w: {r[0] for r in spark.createDataFrame([(w,)], "w string").select(pii.F.xxhash64(pii.F.lit(len(w.split())), "w")).collect()}.pop()
             for w in ("ids:", "a000000", "ids: a000000", "room", "00", "room 00", "ext-000000", "00 ext-000000", ",", "a.b@c.de ,", "w" * 100, "mail " + "w" * 100, "0000000", "00 0000000", "k0", "k00", "k000", "k0 k0", "k0 k00", "k00 k00", "k00 k000", "k000 k000")}
    names = {h: w for w, h in words.items()} | {None: None}
    got = {r.doc_id: [(names[o.p1], names[o.p2]) for o in r["__any"]] for r in found.collect()}
    assert got[0] == [("ids:", None), ("a000000", "ids: a000000")]
    assert got[1] == [("room", None), ("00", "room 00"), ("ext-000000", "00 ext-000000"), (",", "a.b@c.de ,")]
    assert got[2] == [("w" * 100, "mail " + "w" * 100)] and got[3] == [(None, None)] and got[4] == [(None, None), ("0000000", "00 0000000")]
    ks = ["k" + "0" * len(str(i)) for i in range(600)]
    assert got[5] == [(None, None), ("k0", None)] + [(b, f"{a} {b}") for a, b in zip(ks, ks[1:])][:598]


def test_identifiers_that_follow_one_another_are_found(spark):
    rows = [(i, f"staff A{i:05d} +49 30 555{i:04d} in") for i in range(12)] + [(50, "staff A77777 EXT-445566 in"), (51, "staff EXT-445577 in")]
    found = {r.doc_id: r.spans for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[50] == "context:13:23" and found[51] == "" and found[3] == "phone:13:27"


def test_mixture(spark):
    docs = cases.documents(spark)
    rows = mixture.mixed(docs.withColumns(mixture.features()))
    got = rows.collect()
    assert len(got) == len(cases.ROWS)
    total = sum(r["__size"] for r in got)
    targets = {r.source: r["__target"] for r in got}
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    for s, target in targets.items():
        taken, size = sum(r["__taken"] for r in got if r.source == s), sum(r["__size"] for r in got if r.source == s)
        assert target <= 3 * size and abs(taken - target) <= 1 + target * len(targets) / total  # blocks of one word
    assert all(0 <= r["__taken"] <= 3 * r["__size"] for r in got)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, mixture.mixed(docs.repartition(5).withColumns(mixture.features())).select(rows.columns).collect()))
    assert mixture.mix(docs).columns == docs.columns and mixture.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("big, small, size", [(100, 10, 1000), (0, 40_000, 3), (5, 40_000, 70)])
def test_small_and_many_sources_come_near_their_targets(spark, big, small, size):
    """Sources below half a block, and more sources than blocks."""
    rows = spark.range(big).selectExpr("id as doc_id", "'big' as source", "50000000L as __size").union(
        spark.range(5 * small).selectExpr("id + 1000", f"concat('t', id % {small})", f"{size}L")).withColumn("__order", mixture.F.md5(mixture.F.col("doc_id").cast("string")))
    got = mixture.mixed(rows).groupBy("source").agg(mixture.F.sum("__taken").alias("taken"), mixture.F.max("__target").alias("target"), mixture.F.sum("__size").alias("size")).collect()
    total = sum(r["size"] for r in got)
    assert len(got) == small + (big > 0)
    block = max(1, int(min(r.target for r in got) // mixture.FINE))
    for r in got:
        # Half a block, and the part in what all sources' rounding leaves.
        assert abs(r.taken - r.target) <= block * (0.5 + r.target * len(got) / (2 * total)) + 1e-6 * r.target and r.taken <= 3 * r["size"]
        assert r.taken > 0 or r.target < 1
    assert 0 <= total - sum(r.taken for r in got) < block


def test_shards_take_their_quotas(spark):
    """The rows of every source, summed by shard, are the shard's blocks; shards hold the same number of blocks."""
    rng = random.Random(6)
    data = [(k, None if k % 17 == 0 else f"s{min(k % 23, 9)}", rng.choice([0, 1, 7, 300, 20_000])) for k in range(3000)]
    rows = spark.createDataFrame(data, "doc_id long, source string, __size long").withColumn("__order", mixture.F.md5(mixture.F.col("doc_id").cast("string")))
    got = mixture.mixed(rows).collect()
    targets = {r.source: r["__target"] for r in got}
    block = max(1, int(min(targets.values()) // mixture.FINE))
    n = sum(size for _, _, size in data) // block
    ranked = sorted(targets, key=lambda s: (s is None, s))
    claims = sorted(((-targets[s] / (2 * k + 1), i) for i, s in enumerate(ranked) for k in range(int(targets[s] / block) + 9)))[:n]
    first = 0
    for i, s in enumerate(ranked):
        blocks = sum(1 for _, j in claims if j == i)
        own = [r for r in got if r.source == s]
        size = sum(r["__size"] for r in own)
        quota = [sum(1 for b in range(first, first + blocks) if b % 8 == k) * block for k in range(8)]
        given = [sum(r["__shard_words"][k] for r in own) for k in range(8)]
        first += blocks
        assert sum(given) == min(sum(quota), 3 * size) and (given == quota or sum(quota) > 3 * size)
        assert all(sum(r["__shard_words"]) == r["__taken"] <= 3 * r["__size"] for r in own)
    assert first == n


def test_apportionment_gives_highest_quotients(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 300), ("c", 7), ("d", 0), (None, 55)], "source string, source_size long")
    target = mixture.targets(sizes)
    t = {r["rank"]: r.target for r in target.collect()}
    # a, b, c weigh 5, 2, 1, then d 5 and the missing source 2.
    level = (1362 - 21 - 0 - 165) / 7
    assert [round(t[k], 6) for k in (1, 2, 3, 4, 5)] == [round(5 * level, 6), round(2 * level, 6), 21, 0, 165]
    quotas = {(r["rank"], r.shard): r.blocks for r in mixture.quotas(target, 2, 20).collect()}
    order = sorted(((-x / (2 * k + 1), r) for r, x in t.items() for k in range(40) if x))[:20]
    for r in t:
        assert sum(b for (rank, _), b in quotas.items() if rank == r) == sum(1 for _, x in order if x == r)
    assert all(sum(b for (_, s), b in quotas.items() if s == k) == 10 for k in (0, 1))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_positions_are_a_permutation(spark, n):
    from pyspark.sql import functions as F

    places = [r[0] for r in spark.range(n).select(shard.position(F.col("id"), n)).collect()]
    assert sorted(places) == list(range(n)) and (n < 100 or places != sorted(places))


def test_shards(spark):
    docs = cases.documents(spark).withColumnRenamed("lang", "shard")
    out = shard.shard(docs)
    assert out.columns == [*docs.columns, "shard_2", "slot"]
    rows = out.collect()
    places = sorted((r.shard_2, r.slot) for r in rows)
    assert places == sorted((p % 8, p // 8) for p in range(len(cases.ROWS)))
    assert sorted(map(repr, rows)) == sorted(map(repr, shard.shard(docs.repartition(7)).collect()))
    assert shard.shard(docs.limit(0)).count() == 0
    clash = docs.withColumnRenamed("source", "shard_2").withColumnRenamed("n_words", "Slot")
    assert shard.shard(clash).columns == [*clash.columns, "shard_3", "slot_2"] and shard.shard(clash).count() == len(cases.ROWS)
    assert docs.withColumns(shard.features()).where("doc_id = 9").first()["__crc"] == zlib.crc32(cases.ROWS[11][1].encode())


@pytest.mark.parametrize("block_words, chunk", [(200_000, 64_000_000), (5, 64_000_000), (5, 1)])
def test_decontamination(spark, block_words, chunk):
    rng = random.Random(4)
    vocabulary = ["a", "b", "the", "Éa", "x9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 13, 14, 30])))) for i in range(12)] + [(50, None), (None, "the a"), (3, "b b b b")]
    rows = [(i, ", ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(100, items[5][1].upper().replace("É", "É")), (101, None), (102, "")]
    found = decontaminate.scan(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words, chunk=chunk).collect()
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    for r in found:
        w, hit, ids = split(r.text), set(), set()
        for item, text in items:
            p = split(text)
            m = min(13, len(p))
            for k in range(len(p) - m + 1 if m and item is not None else 0):
                for i in range(len(w) - m + 1):
                    if w[i : i + m] == p[k : k + m]:
                        hit.update(range(i, i + m))
                        ids.add(str(item))
        assert (r["__n_words"], r["__n_hit"], r["__items"]) == (len(w), len(hit), sorted(ids))


def test_decontamination_odd_rows(spark):
    docs, empty = cases.documents(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, empty).count() == len(cases.ROWS) and decontaminate.clean(docs.limit(0), empty).count() == 0
    held = spark.createDataFrame([(1, cases.PASSAGE)], "item_id long, text string")
    assert sorted(r.doc_id or 0 for r in decontaminate.clean(docs, held).collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10, 11]


URLS = [
    "http://a.net/x", "http://net/", "http://net", "https://u.example.net/en/1?x=://q", "HTTP://EXAMPLE.NET/en/", "http://example.net/EN/", "x://example.com/de/#f", "http://www.example.org/fr/",
    "http://org/fr", "http://cheap-pills.example.com/de/", "http://www.cheap-pills.example.com?x", "http://spam-farm.example.org/fr/1", "http://spam-farm.example.org/", "no scheme", "", None,
    "http://xnet/", "http://.net/a", "http://a..net/b", "://net/", "http://example.net:80/en/", "http://ÉXAMPLE.net/ü",
]


def test_url_filter_in_one_block_and_in_many(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    known = url_filter.entries(spark)
    by_block = sorted(map(tuple, url_filter.judge(pages, known).select("page_id", "__host", "__path", "__rule", "__verdict").collect()))
    by_blocks = sorted(map(tuple, url_filter.judge(pages, known, block=1).select("page_id", "__host", "__path", "__rule", "__verdict").collect()))
    assert by_block == by_blocks and len(by_block) == len(URLS)
    for i, host, path, rule, verdict in by_block:
        url = URLS[i] or ""
        if "://" not in url:
            assert (host, path, rule, verdict) == ("", "", None, "allow")
            continue
        fits = [(len(e), e, v) for e, v in url_filter.RULES if (host == e.split("/", 1)[0] or host.endswith("." + e.split("/", 1)[0])) and path.startswith("/" + e.split("/", 1)[1])]
        listed = any((host == e[:-1] or host.endswith("." + e[:-1])) and path.startswith("/") for e in url_filter.BLOCKED)
        assert (rule, verdict) == (max(fits)[1:] if fits else (None, "block" if listed else "allow"))
    assert url_filter.judge(pages.limit(0), known).count() == 0


def test_url_rules_of_equal_length(spark):
    """The one with the longer host holds."""
    pages = spark.createDataFrame([(1, "http://a.net/ab", "x")], "page_id long, url string, rule string")
    known = url_filter.entries(spark, [("a.net/", "block"), ("net/ab", "allow")], [])
    for most in (10, 1):
        assert [(r["__rule"], r["__verdict"]) for r in url_filter.judge(pages, known, block=most).collect()] == [("a.net/", "block")]


def test_keys_of_a_long_host_are_as_short_as_the_entries(spark):
    long = "a." * 50_000 + "spam.example.net"
    keys = url_filter.keys_of(long, "/x/y", [1, 3], 16)
    assert keys == [b"spam.example.net/", b"spam.example.net/x/", b"example.net/", b"example.net/x/", b"net/", b"net/x/"]
    assert url_filter.keys_of("net", "/", [1], 3) == [b"net/"] and url_filter.keys_of("anet", "/", [1], 3) == [] and url_filter.keys_of("a.net", "/", [1], 3) == [b"net/"]
    urls = ["http://" + long + "/x", "http://" + "a" * 200_000 + "/x", "http://" + "." * 100_000 + "/x", "http://" + "b." * 100_000 + "org/fr/", "http://xspam.example.net/", "http://spam.example.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = url_filter.entries(spark, [("spam.example.net/", "block"), ("org/fr/", "allow")], ["net/"])
    for most in (10, 1):
        got = {r.page_id: (r["__rule"], r["__verdict"]) for r in url_filter.judge(pages, known, block=most).collect()}
        assert got == {0: ("spam.example.net/", "block"), 1: (None, "allow"), 2: (None, "allow"), 3: ("org/fr/", "allow"), 4: (None, "block"), 5: ("spam.example.net/", "block")}


def test_equal_digests_are_told_apart(tmp_path):
    url_filter.write_index(pa.table({"digest": [7, 7, 7], "entry": ["a.org/", "b.org/", "c.org/"], "flag": [1, 3, 0]}), str(tmp_path / "index"))
    index = url_filter.Index(str(tmp_path / "index"))
    found = index.find([b"c.org/", b"d.org/", b"a.org/", b"b.org/"], np.array([7, 7, 7, 8]))
    assert {k: index.entry(i) for k, i in found.items()} == {0: b"c.org/", 2: b"a.org/"}
    assert {k: int(index.flags[i]) for k, i in found.items()} == {0: 0, 2: 1}


@pytest.mark.parametrize("block", [1_000_000, 700])
def test_url_filter_with_a_long_list(spark, block):
    """A list of 20,000 hosts, some with paths, made by Spark, against a plain look at all suffixes."""
    F = url_filter.F
    listed = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id") * 7, F.when(F.col("id") % 3 == 0, ".example.org/a").when(F.col("id") % 3 == 1, ".net/").otherwise(".ü.net/")).alias("entry"),
                                        F.lit("block").alias("verdict"), F.lit(True).alias("listed"))
    known = listed.unionByName(url_filter.entries(spark, [("net/b", "allow"), ("h7.net/", "block")], []))
    entries = {r.entry for r in listed.collect()}
    urls = [f"http://{sub}h{k}{end}" for k in range(0, 2100) for sub, end in (("", ".example.org/a"), ("w.", ".net/b/c"), ("x.y.", ".net/c"), ("", ".ü.net"), ("", ".ü.net/"))]
    got = {r.page_id: (r["__rule"], r["__verdict"]) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3), known, block).collect()}
    for i, url in enumerate(urls):
        host, slash, path = url[7:].partition("/")
        fits = {f"{host[s:]}/{path[:n]}" for s in range(len(host)) if s == 0 or host[s - 1] == "." for n in range(len(path) + 1)} if slash else set()
        rule = next((r for r in ("h7.net/", "net/b") if r in fits), None)
        assert got[i] == ((rule, "allow" if rule == "net/b" else "block") if rule else (None, "block" if fits & entries else "allow"))


def test_url_filter_without_entries(spark):
    pages = spark.createDataFrame([(1, "http://a.net/ab"), (2, None)], "page_id long, url string")
    assert {(r["__rule"], r["__verdict"]) for r in url_filter.judge(pages, url_filter.entries(spark).limit(0)).collect()} == {(None, "allow")}


def test_html_blocks():
    page = "<head><title>t</title></head><body><script>var a='<p>no</p>'</script><div>a<b>b</b>&amp;\n c<br>d<p>e<p hidden>f</p><!-- <p>x</p> --><td>g<a href='>'>h</a></body><p"
    assert [b[0] for b in html_text.blocks(page)] == ["ab& c", "d", "e", "f", "gh"]
    assert html_text.blocks(None) == html_text.blocks("") == html_text.blocks("<div></div>") == []
    assert [b[0] for b in html_text.blocks("a < b <3 &lt;p&gt; <")] == ["a < b <3 <p> <"]


@pytest.mark.parametrize("page, texts", [
    ("<html><head><title>t</title><body><article><p>one</p><p>two</p></article>", ["one", "two"]),
    ("<head><meta charset=x><article><p>one", ["one"]),
    ("<p>one <svg viewBox='0 0 1 1'/> two</p><p>three</p>", ["one two", "three"]),
    ("<p>one <svg><title>t</title><path d='M0'/><text>two</text></svg> three</p>", ["one two three"]),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", ["so x=2 holds"]),
    ("<object data=x><p>one</p></object><object data=y>two<p>three</p>", ["one", "two", "three"]),
    ("<div><button>ok<p>one</p><button>go</button><p>two</p></div><p>three", ["ok", "one", "go", "two", "three"]),
    ("<form><select><option>a<option>b</form><p>one</p>", ["a", "b", "one"]),
    ("<noscript>one<p>two", ["one", "two"]),
])
def test_html_ends_left_out(page, texts):
    found = html_text.blocks(page)
    assert [b[0] for b in found] == texts
    assert all(("tag:button" in b[1]) == (b[0] == "go") and "tag:select" not in b[1] for b in found)


def test_page_without_end_of_head_keeps_its_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    whole = [r.html for r in pages.where("html like '%</head>%'").orderBy("page_id").limit(20).collect()]
    field = html_text.train(pages)
    for page in whole:
        assert html_text.text_of(page.replace("</head>", ""), field) == html_text.text_of(page, field) != ""


def test_html_extraction_held_out(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    field = html_text.train(pages)
    rng, right, n = random.Random(77), 0, 0
    sentences = ["some words in a row that make a sentence of fair length.", "Another, shorter one", "short"]
    for _ in range(200):
        page, labels = html_text.compose(rng, sentences)
        got = field.decode(html_text.blocks(page))
        right, n = right + sum(a == b for a, b in zip(got, labels)), n + len(labels)
    assert right / n > 0.9
    odd = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<article><p>" + "Word and more words. " * 20_000)], "page_id long, url string, html string")
    found = {r.page_id: r["__text"] for r in html_text.extract(odd, field).collect()}
    assert found[1] == found[2] == "" and len(found[3]) == 21 * 20_000 - 1
    assert html_text.extract(odd.limit(0)).count() == 0


def test_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = out.collect()
    assert out.columns == [*docs.columns, "shard", "slot"] and rows
    assert sorted((r.shard, r.slot) for r in rows) == sorted((p % 8, p // 8) for p in range(len(rows)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "source_mixture", "sharding"]


def quality_by_hand(rows):
    """The rows that the rules and the hosts' rates keep."""
    failed, doubt = [], []
    for r in rows:
        text = r.text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, chars = len(w), sum(map(len, w))
        failed.append(n < 10 or 100 * len(again) > 20 * n)
        doubt.append(10 * sum(c in quality.SYMBOLS for c in text) > n or chars < 2 * n or chars > 15 * n or 10 * (len(lines) - len(set(lines))) > n)
    hosts = {}
    for r, a, b in zip(rows, failed, doubt):
        n, bad = hosts.get(r.source, (0, 0))
        hosts[r.source] = (n + 1, bad + (a or b))
    rates = [bad / n for n, bad in hosts.values()]
    mean, var = statistics.mean(rates), statistics.variance(rates)
    strength = max(mean * (1 - mean) / var - 1, 1e-3)
    suspect = {h for h, (n, bad) in hosts.items() if (bad + mean * strength) / (n + strength) > quality.SUSPECT}
    return [r for r, a, b in zip(rows, failed, doubt) if not a and not (b and r.source in suspect)]


def hits_by_hand(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    windows = {}
    for item in items:
        m = min(13, len(item))
        windows.setdefault(m, set()).update(tuple(item[i : i + m]) for i in range(len(item) - m + 1) if m)
    hit = {j for m, known in windows.items() for i in range(len(words) - m + 1) if tuple(words[i : i + m]) in known for j in range(i, i + m)}
    return len(words), len(hit)


def test_pipeline_stages_by_hand(spark, sf, tmp_path):
    """Every stage on what its predecessor kept, with odd, repeated and contaminated rows, a spam host and clashing names."""
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").where("text is not null").limit(40).collect()]
    spam = "x # # # # y z u v w q r s t"
    rows = [*cases.ROWS, *((400 + i, f"{spam} {i}", "en", "spam", 1) for i in range(30)), *((500 + i, f"before it {t} and after", "en", "a", 1) for i, t in enumerate(bench[:5]))]
    docs = spark.createDataFrame(rows, cases.DDL).unionByName(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "1L as n_words"))
    docs = docs.withColumnRenamed("lang", "Shard").withColumnRenamed("n_words", "slot")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tables, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        now = corpus_pipeline.stage(step(spark, now, str(tmp_path)), name)
        tables.append(now.collect())
    given, (kept, single, clean, mixed, sharded) = docs.collect(), tables

    def plain(found):
        return sorted(map(repr, found))

    assert plain(kept) == plain(quality_by_hand(given)) and 0 < sum(r.source == "spam" for r in given) > sum(r.source == "spam" for r in kept)
    distinct = sorted({(r.doc_id if r.doc_id is not None else 2**63 - 1, r.text) for r in kept})
    groups = near(distinct)[1]
    assert len(distinct) < len(kept) and sorted(r.doc_id if r.doc_id is not None else 2**63 - 1 for r in single) == sorted({g: distinct[g][0] for g in groups}.values())
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in bench]
    left = []
    for r in single:
        n, hit = hits_by_hand(r.text, items)
        left += [] if hit and 20 * hit >= n else [r]
    assert plain(clean) == plain(left) and len(left) < len(single)
    size = {repr(r): len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]) for r in clean}
    assert {repr(r) for r in mixed} <= set(size) and max(Counter(map(repr, mixed)).values()) <= 3
    sources = sorted({r.source for r in clean}, key=lambda x: (x is None, x))
    sums = {x: sum(size[repr(r)] for r in clean if r.source == x) for x in sources}
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(sources)}
    target, open_ = {}, list(sources)
    while open_:
        level = (sum(sums.values()) - sum(target.values())) / sum(weight[x] for x in open_)
        above = [x for x in open_ if level * weight[x] > 3 * sums[x]]
        target.update({x: 3 * sums[x] if above else level * weight[x] for x in above or open_})
        open_ = [x for x in open_ if x not in target]
    for x in sources:
        longest = max(size[repr(r)] for r in clean if r.source == x)
        assert abs(sum(size[repr(r)] for r in mixed if r.source == x) - target[x]) <= longest / 2 + 2 + target[x] / 100
    assert plain(tuple(r)[:-2] for r in sharded) == plain(map(tuple, mixed)) and [*sharded[0].asDict()][-2:] == ["shard_2", "slot_2"]
    assert sorted((r.shard_2, r.slot_2) for r in sharded) == sorted((p % 8, p // 8) for p in range(len(mixed)))


def test_pipeline_without_rows(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
