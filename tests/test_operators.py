"""Literal cases for scalar rules, codecs and operators."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import codecs, scalars
from tessera.operators import collections as C
from tessera.operators import extras, keys, memory, server, writes

NOW = 1_000_000
SHAPE = "db int, key string, type string, val string, expire_at_ms long, access_ms long"


def _k(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def _one(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.collect()]


def test_slots(spark):
    want = {"foo": 12182, "bar": 5061, "hello": 866, "key:1": 6657, "": 0}
    rows = spark.createDataFrame([(k,) for k in want], "key string").select("key", scalars.slot(F.col("key")).alias("s")).collect()
    assert {r["key"]: r["s"] for r in rows} == want
    tags = spark.createDataFrame([("{user}a",), ("user",), ("{}user",), ("a{b",), ("x{user}{y}",)], "key string").select("key", scalars.hash_tag(F.col("key")).alias("t")).collect()
    assert [r["t"] for r in tags] == ["user", "user", "{}user", "a{b", "user"]


GLOBS = [("*", "abc", True), ("t*", "two", True), ("h[ae]llo", "hallo", True), ("h[ae]llo", "hillo", False), ("h?llo", "hello", True), ("h[^e]llo", "hello", False), ("h[^e]llo", "hxllo", True), ("[z-a]x", "mx", True),
         ("a\\*b", "a*b", True), ("a\\*b", "axb", False), ("a[bc", "ab", True), ("a.c", "abc", False), ("a*c", "a\nc", True), ("a", "a\n", False), ("x\\", "x\\", True), ("", "", True), ("a[]b", "ab", False)]


def test_globs(spark):
    for pattern, text, want in GLOBS:
        row = spark.createDataFrame([(text,)], "t string").select(scalars.glob(F.col("t"), pattern).alias("m")).first()
        assert row["m"] is want, (pattern, text)


def test_numbers(spark):
    longs = {"0": 0, "-0": None, "-7": -7, "007": None, " 7": None, "+7": None, "9223372036854775807": 2**63 - 1, "9223372036854775808": None, "-9223372036854775808": -(2**63), "7\n": None, "": None}
    rows = spark.createDataFrame([(k,) for k in longs], "t string").select("t", scalars.strict_long(F.col("t")).alias("n"), scalars.strict_unsigned(F.col("t")).alias("u")).collect()
    assert {r["t"]: r["n"] for r in rows} == longs
    assert {r["t"]: r["u"] for r in rows}["9223372036854775808"] == 2**63
    doubles = {"5.": 5.0, ".5": 0.5, "1e3": 1000.0, "inf": float("inf"), "-Infinity": float("-inf"), "nan": None, "1d": None, " 1": None, "": None, ".": None}
    rows = spark.createDataFrame([(k,) for k in doubles], "t string").select("t", scalars.strict_double(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == doubles


def test_encodings(spark):
    want = {"12345": "int", "hello": "embstr", "x" * 100: "raw", "a" * 44: "embstr", "a" * 45: "raw", "0123": "embstr", "1" * 21: "embstr", "": "embstr"}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", scalars.encoding(F.col("t")).alias("e")).collect()
    assert {r["t"]: r["e"] for r in rows} == want
    assert [scalars.memory_size(x) for x in ("1", "2k", "2kb", "3GB", "x", "1tb", "99999999999gb")] == [1, 2000, 2048, 3 * 1024**3, None, None, None]


def test_codecs(spark):
    assert codecs.crc64(b"123456789") == codecs.CRC64_CHECK
    rng = random.Random(5)
    for n in (0, 1, 3, 40, 300, 9000):
        data = bytes(rng.choice(b"abc") for _ in range(n))
        assert codecs.lzf_decompress(codecs.lzf_compress(data)) == data
        assert codecs.unseal(codecs.seal(data)) == data
        assert codecs.unseal(codecs.seal(data)[:-1] + b"\x00\x01") is None
    assert [codecs.float_text(x) for x in (3.0, -0.0, 0.1, 1e-7, 2e23, 5e-324, 1.5, float("inf"), float("nan"))] == ["3", "-0", "0.1", "1e-7", "2e+23", "5e-324", "1.5", "inf", "nan"]
    for _ in range(500):
        x = rng.choice([rng.uniform(-1, 1), rng.uniform(-1e20, 1e20), rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300)])
        assert float(codecs.float_text(x)) == x
    assert codecs.human_text(10.5) == "10.5"


def test_expiry_is_inclusive(spark):
    k = _k(spark, [(0, "a", "string", "1", NOW, 0), (0, "b", "string", "1", NOW + 1, 0), (0, "c", "string", "1", None, 0)])
    assert sorted(r["key"] for r in keys.live(k, NOW).collect()) == ["b", "c"]
    assert keys.dbsize(k).first()["n"] == 3
    assert _one(memory.active_expire(k, NOW), "key") == [("a",)]
    assert sorted(_one(keys.ttl(k, spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), NOW), "key", "ttl", "pttl")) == [("a", -2, -2), ("b", 0, 1), ("c", -1, -1)]


def test_expire_conditions(spark):
    at, replies = None, []
    for condition, seconds in (("NX", 100), ("NX", 200), ("XX", 300), ("GT", 200), ("GT", 400), ("LT", 500), ("LT", 50)):
        k = _k(spark, [(0, "a", "string", "1", at, 0)])
        row = writes.expire(k, spark.createDataFrame([("a", seconds)], "key string, amount long"), NOW, condition=condition).first()
        replies.append(row["reply"])
        at = row["expire_at_ms"]
    assert replies == [1, 0, 1, 0, 1, 0, 1]
    k = _k(spark, [(0, "a", "string", "1", None, 0)])
    ask = lambda n, **o: writes.expire(k, spark.createDataFrame([("a", n)], "key string, amount long"), NOW, **o).first()
    assert ask(100, condition="GT")["reply"] == 0 and ask(100, condition="LT")["reply"] == 1 and ask(100, condition="XX")["reply"] == 0
    assert (ask(-1)["reply"], ask(-1)["event"]) == (1, "del")
    assert ask(2**62)["reply"] is None


def test_set_batch(spark):
    k = _k(spark, [(0, "a", "string", "old", NOW + 5, 0), (0, "l", "list", None, None, 0)])
    batch = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "n", "p"), (4, "n", "q"), (5, "l", "s")], "ordinal long, key string, val string")
    got = {r["key"]: (r["type"], r["val"], r["expire_at_ms"], r["applied"]) for r in writes.set_keys(k, batch, NOW).collect()}
    assert got == {"a": ("string", "y", None, True), "n": ("string", "q", None, True), "l": ("string", "s", None, True)}
    got = {r["key"]: r["val"] for r in writes.set_keys(k, batch, NOW, only="NX").collect()}
    assert got == {"a": "old", "n": "p", "l": None}
    got = {r["key"]: (r["val"], r["expire_at_ms"]) for r in writes.set_keys(k, batch, NOW, only="XX", keep_ttl=True).collect()}
    assert got == {"a": ("y", NOW + 5), "l": ("s", None)}
    assert writes.set_keys(k, batch, NOW, deadline=F.lit(-4).cast("long")).filter("key = 'a'").first()["expire_at_ms"] == 0
    probes = spark.createDataFrame([(1, "l"), (2, "a"), (3, "z")], "ordinal long, key string")
    assert sorted(_one(keys.mget(k, probes, NOW), "ordinal", "val"), key=lambda r: r[0]) == [(1, None), (2, "old"), (3, None)]
    assert {r["key"]: r["wrong_type"] for r in keys.get(k, probes.select("key"), NOW).collect()} == {"l": True, "a": False, "z": False}


def test_moves(spark):
    k = _k(spark, [(0, "a", "string", "1", None, 0), (0, "b", "string", "2", None, 0), (1, "b", "string", "3", None, 0)])
    pair = lambda a, b: spark.createDataFrame([(a, b)], "src string, dst string")
    rows = lambda f: sorted(_one(f, "db", "key", "val"))
    assert rows(writes.rename(k, pair("a", "b"), NOW)) == [(0, "b", "1"), (1, "b", "3")]
    assert rows(writes.rename(k, pair("a", "b"), NOW, only_new=True)) == rows(k)
    assert rows(writes.rename(k, pair("a", "a"), NOW)) == rows(k)
    assert rows(writes.copy(k, pair("a", "b"), NOW, to_db=1)) == rows(k)
    assert rows(writes.copy(k, pair("a", "b"), NOW, to_db=1, replace=True)) == [(0, "a", "1"), (0, "b", "2"), (1, "b", "1")]
    both = spark.createDataFrame([("a",), ("b",)], "key string")
    assert rows(writes.move(k, both, NOW, to_db=1)) == [(0, "b", "2"), (1, "a", "1"), (1, "b", "3")]


def test_lists_follow_a_model(spark):
    rng = random.Random(2)
    for _ in range(4):
        model = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        rows = spark.createDataFrame([("k", i, e) for i, e in enumerate(model)], "key string, pos long, elem string")
        read = lambda f: [r["elem"] for r in f.orderBy("pos").collect()]
        count = rng.choice([0, 1, -1, 2])
        want, left = list(model), abs(count) or len(model)
        order = range(len(model)) if count >= 0 else reversed(range(len(model)))
        gone = [i for i in order if model[i] == "a"][:left]
        assert read(C.list_remove_value(rows, "a", count)) == [e for i, e in enumerate(want) if i not in gone]
        i, j = rng.randint(-5, 5), rng.randint(-5, 5)
        assert read(C.list_range(rows, i, j)) == [e for n, e in enumerate(model) if (i if i >= 0 else len(model) + i) <= n <= (j if j >= 0 else len(model) + j)]
        items = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("new", 1, "z")], "key string, ordinal int, elem string")
        assert read(C.list_push(rows, items).filter("key = 'k'")) == [*model, "x", "y"]
        assert read(C.list_push(rows, items, front=True).filter("key = 'k'")) == ["y", "x", *model]
        assert read(C.list_set(rows, -1, "last")) == [*model[:-1], "last"]


def test_seeks(spark):
    rows = spark.createDataFrame([("s", 10, 0), ("s", 10, 1), ("s", 20, 0)], "key string, ms long, seq long")
    ids = lambda f: sorted((r["ms"], r["seq"]) for r in f.collect())
    assert ids(C.seek(rows, "le", 15)) == [(10, 1), (20, 0)]
    assert ids(C.seek(rows, "lt", 10, 1)) == [(10, 0), (10, 1), (20, 0)]
    assert ids(C.seek(rows, "lt", 10, 0)) == []
    assert ids(C.seek_back(rows, "gt", 10, 1)) == [(10, 0), (10, 1), (20, 0)]
    assert ids(C.seek_back(rows, "ge", 21)) == []


def test_sort_rules(spark):
    elements = spark.createDataFrame([("k", e) for e in ("1", "3", "2", "9")], "key string, elem string")
    lookup = spark.createDataFrame([("w_1", None, "5"), ("w_2", None, "5"), ("w_3", None, "-1")], "key string, field string, value string")
    order = lambda **o: [r["elem"] for r in C.sort_elements(elements, lookup=lookup, **o).orderBy("place").collect()]
    assert order() == ["1", "2", "3", "9"] and order(desc=True) == ["9", "3", "2", "1"]
    assert order(by="w_*") == ["3", "9", "1", "2"] and order(by="w_*", desc=True) == ["2", "1", "9", "3"]
    assert order(by="w_*", alpha=True) == ["9", "3", "1", "2"]
    assert order(offset=1, count=2) == ["2", "3"] and order(offset=3, count=-1) == ["9"]


def test_eviction_is_exact(spark):
    rows = [(0, f"k{i:03}", "string", "v", NOW + i if i % 2 else None, i * 7 % 101) for i in range(200)]
    k = _k(spark, rows)
    want, freed = [], 0
    for r in sorted(rows, key=lambda r: (-(NOW - r[5]), r[1])):
        if freed >= 1500:
            break
        want.append(r[1])
        freed += len(r[1]) + 1 + 64 + (24 if r[4] else 0)
    assert sorted(r["key"] for r in memory.evict(k, "allkeys-lru", 1500, NOW).collect()) == sorted(want)
    assert memory.evict(k, "allkeys-lru", 0, NOW).count() == 0
    assert memory.evict(k, "volatile-ttl", 10**9, NOW).count() == 100
    assert memory.over_limit(k, 1, "noeviction").first()["refuse"] and not memory.over_limit(k, 1, "volatile-lru").first()["refuse"]


def test_server(spark):
    assert server.catalogue(spark, ["GET", "nope"]).count() == 1 and server.catalogue(spark).count() == 45
    settings = server.Settings()
    assert settings.get("MAXMEMORY-policy") == "noeviction" and settings.get("nope") is None
    assert settings.set_many({"maxmemory": "1kb", "databases": "4"}).maxmemory == 1024
    with pytest.raises(ValueError):
        settings.set_many({"databases": "4", "shards": "3"})
    session = server.Session()
    session.select("3")
    assert session.db == 3 and session.ping() == "PONG" and session.hello(3)["proto"] == 3
    with pytest.raises(ValueError):
        session.select("16")
    payload = codecs.seal(b"v")
    rows = spark.createDataFrame([("a", 0, payload), ("b", 5, payload), ("c", -1, payload), ("d", 0, payload[:-1] + b"?")], "key string, ttl_ms long, payload binary")
    got = {r["key"]: (r["val"], r["expire_at_ms"], r["error"]) for r in server.restore(rows, NOW).collect()}
    assert got == {"a": ("v", None, None), "b": ("v", NOW + 5, None), "c": (None, None, "invalid ttl"), "d": (None, None, "bad payload")}


def test_scan_sees_every_key(spark):
    k = _k(spark, [(0, f"key:{i}", "string", "v", None, 0) for i in range(300)])
    whole = keys.scan(k, NOW, shards=4, bits=4)
    assert whole.count() == 300
    parts = [keys.scan(k, NOW, shards=4, bits=4, shard=s).count() for s in range(4)]
    assert sum(parts) == 300 and keys.scan(k, NOW, shards=4, bits=4, pattern="key:1?").count() == 10


def test_extras(spark):
    text = spark.createDataFrame([("hello",)], "t string")
    got = [bytes(text.select(extras.get_range(F.col("t"), a, b).alias("x")).first()["x"]) for a, b in ((0, 1), (-3, -1), (3, 99), (9, 12), (-99, 0))]
    assert got == [b"he", b"llo", b"lo", b"", b"h"]
    d = spark.range(1).select(extras.distance_m(F.lit(13.361389), F.lit(38.115556), F.lit(15.087269), F.lit(37.502669)).alias("d")).first()["d"]
    assert abs(d - 166274.2) < 0.2


def wide(spark):
    rows = [(d, f"k{i}", "string" if (i + d) % 3 else "list", f"v{i}" if (i + d) % 3 else None, (None, NOW + 5000, NOW - 5)[i % 3], NOW - i, (i * 5) % 7) for d in range(3) for i in range(40)]
    return spark.createDataFrame(rows, "db int, key string, type string, val string, expire_at_ms long, access_ms long, freq int")


def test_writes_keep_other_databases(spark):
    k = wide(spark)
    batch = spark.createDataFrame([(1, "k1", "x"), (2, "k1", "y"), (3, "new", "z")], "ordinal int, key string, val string")
    got = {(r["db"], r["key"]): r["val"] for r in writes.mset(k, batch, NOW, db=1).collect()}
    live = {(r["db"], r["key"]): r["val"] for r in k.collect() if r["expire_at_ms"] is None or r["expire_at_ms"] > NOW}
    assert got == live | {(1, "k1"): "y", (1, "new"): "z"}
    with pytest.raises(ValueError):
        writes.set_keys(k, batch, NOW, only="ZZ")
    with pytest.raises(ValueError):
        writes.set_keys(k, batch, NOW, keep_ttl=True, deadline=F.lit(5))


def test_renames_to_one_name(spark):
    k = wide(spark).filter("key IN ('k0', 'k3', 'k6') AND db = 0")
    pairs = spark.createDataFrame([(1, "k0", "z"), (2, "k3", "z"), (3, "k6", "k0")], "ordinal int, src string, dst string")
    assert {(r["key"], r["access_ms"]) for r in writes.rename(k, pairs, NOW).collect()} == {("z", NOW - 3), ("k0", NOW - 6)}
    assert {(r["key"], r["access_ms"]) for r in writes.rename(k, pairs, NOW, only_new=True).collect()} == {("z", NOW), ("k3", NOW - 3), ("k6", NOW - 6)}


@pytest.mark.parametrize("policy", memory.POLICIES)
@pytest.mark.parametrize("few", [1, 5, 100_000])
def test_eviction_by_every_policy(spark, monkeypatch, policy, few):
    monkeypatch.setattr(memory, "EDGE_ROWS", few)
    monkeypatch.setattr(memory, "BUCKETS", 3 if few < 10 else 4096)
    k = wide(spark).select("*", memory.score(policy, NOW).alias("s"), memory.cost().alias("b")) if policy != "noeviction" else wide(spark)
    got = {(r["db"], r["key"]) for r in memory.evict(wide(spark), policy, 2500, NOW).collect()}
    want, freed = set(), 0
    for r in sorted(k.collect(), key=lambda r: (-(r["s"] or 0), r["key"], r["db"])) if policy != "noeviction" else ():
        if policy.startswith("allkeys") or r["expire_at_ms"] is not None:
            if freed < 2500:
                want.add((r["db"], r["key"]))
            freed += r["b"]
    assert got == want


def test_scan_pages_see_every_key(spark):
    k = wide(spark).filter("db = 2")
    cursor, seen, pages = 0, [], 0
    while True:
        page, cursor = keys.scan_page(k, NOW, cursor, count=7, shards=4, bits=3, db=2)
        seen += [r["key"] for r in page.collect()]
        pages += 1
        if cursor == 0:
            break
    assert sorted(seen) == sorted(r["key"] for r in keys.live(k, NOW).collect()) and pages > 2
    assert {r["key"] for r in keys.scan_page(k, NOW, 0, count=1000, shards=4, bits=3, db=2, kind="list")[0].collect()} == {r["key"] for r in keys.live(k, NOW).collect() if r["type"] == "list"}


def test_restore_options(spark):
    k = wide(spark)
    from tessera.functions import codecs

    rows = [(1, "k0", 0, codecs.seal(b"a")), (2, "n", 9, codecs.seal(b"b")), (3, "n", 0, codecs.seal(b"c")), (4, "m", -1, codecs.seal(b"d")), (5, "o", 0, codecs.seal(b"e")[:-1] + b"?")]
    payloads = spark.createDataFrame(rows, "ordinal int, key string, ttl_ms long, payload binary")
    kept, replies = server.restore_into(k, payloads, NOW, idle_s=3)
    assert {(r["ordinal"], r["error"]) for r in replies.collect()} == {(1, "BUSYKEY"), (2, None), (3, "BUSYKEY"), (4, "invalid ttl"), (5, "bad payload")}
    assert [(r["val"], r["expire_at_ms"], r["access_ms"], r["freq"]) for r in kept.filter("key = 'n'").collect()] == [("b", NOW + 9, NOW - 3000, 5)]
    kept, replies = server.restore_into(k, payloads, NOW, replace=True, absolute=True, freq=200)
    assert {(r["key"], r["val"], r["freq"]) for r in kept.filter("db = 0 AND key IN ('k0', 'n')").collect()} == {("k0", "a", 200), ("n", "c", 200)}
    with pytest.raises(ValueError):
        server.restore_into(k, payloads, NOW, freq=256)


def test_notification_flags(spark):
    changes = spark.createDataFrame([(0, "a", "set", "string"), (1, "b", "expired", "expired"), (1, "c", "new", "new")], "db int, key string, event string, class string")
    got = lambda flags: sorted(tuple(r) for r in writes.notifications(changes, flags).collect())
    assert got("Kx") == [("__keyspace@1__:b", "expired")] and got("E$") == [("__keyevent@0__:set", "a")]
    assert got("g$lshzxetd") == [] and len(got("KEA")) == 4 and len(got("KEAn")) == 6
    with pytest.raises(ValueError):
        writes.notifications(changes, "KEq")


def test_number_text_and_checksums():
    from tessera.functions import codecs

    text = {1e20: "1e+20", 0.00012345: "1.2345e-4", 123456.123456789: "1.23456123456789e+5", 1.2345678901234569e23: "123456789012345690000000", 5e-324: "5e-324", 3e-05: "0.00003", -1.5: "-1.5", 1e-7: "1e-7", 2.0**61: "2305843009213693952"}
    assert {x: codecs.float_text(x) for x in text} == text
    values = [bytes(range(n % 256)) * (1 + n % 3) for n in range(120)] + [b"123456789"]
    assert codecs.crc64_many(values) == [codecs.crc64(v) for v in values] and codecs.crc64_many(values)[-1] == codecs.CRC64_CHECK


def test_sort_of_words_fails_and_settings_have_their_names(spark):
    rows = spark.createDataFrame([("l", "x"), ("l", "3")], "key string, elem string")
    with pytest.raises(Exception, match="converted into double"):
        C.sort_elements(rows).collect()
    assert C.sort_errors(rows).count() == 1 and C.sort_elements(rows, alpha=True).count() == 2
    names = "port databases maxmemory maxmemory-policy appendonly appendfsync requirepass timeout tcp-keepalive hash-max-listpack-entries hash-max-listpack-value list-max-listpack-size set-max-intset-entries set-max-listpack-entries zset-max-listpack-entries zset-max-listpack-value proto-max-bulk-len notify-keyspace-events shard-count save"
    assert all(server.Settings().get(n) is not None for n in names.split()) and server.Settings().get("nothing") is None
    info = {r["name"]: r for r in server.command_info(spark, ["DEL", "nope"]).collect()}
    assert info["del"]["flags"] == ["write"] and info["del"]["tips"] == ["request_policy:multi_shard", "response_policy:agg_sum"] and None in info
    assert keys.object_help()[0] == "ENCODING <key>" and scalars.shard_of("foo", 16384) == 12182 and scalars.shard_of("{bar}x", 16384) == 5061
    with pytest.raises(ValueError):
        keys.object_freq(rows, "allkeys-lru")


def _partitions(frame):
    """Tasks of the last step, as adaptive execution leaves them."""
    return frame.rdd.getNumPartitions()


def test_sort_store_deals_rows_by_the_size_of_the_table(spark, monkeypatch):
    from tessera.plans import catalogue

    monkeypatch.setattr(keys, "SHARE", 4000)
    assert _partitions(catalogue.queries()["sort_store"](spark, "/root/testdata/sf0.001")) >= 20
    lists = spark.createDataFrame([("a", 3, "x"), ("a", 7, "y"), ("s:b", 0, "old"), ("s:b", 1, "older")], "key string, pos long, elem string")
    found = C.sort_elements(spark.createDataFrame([("b", "3"), ("b", "1"), ("b", "2")], "key string, elem string"), offset=1)
    got = C.sort_store(lists, found, F.concat(F.lit("s:"), F.col("key")))
    assert sorted(map(tuple, got.collect())) == [("a", 0, "x"), ("a", 1, "y"), ("s:b", 0, "2"), ("s:b", 1, "3")]


def test_restore_deals_rows_by_the_size_of_the_tables(spark, monkeypatch):
    from tessera.plans import catalogue

    monkeypatch.setattr(keys, "SHARE", 1500)
    assert _partitions(catalogue.queries()["restore_where_free"](spark, "/root/testdata/sf0.001")) >= 40


def test_lzf_takes_long_repeats_and_long_texts_in_blocks(monkeypatch):
    from tessera.functions import codecs

    rng = random.Random(4)
    texts = [b"", b"a", b"ab", b"abc", b"a" * 1000, b"ab" * 700, bytes(rng.randrange(256) for _ in range(3000)), b"".join(rng.choice((b"the ", b"and ", b"of ", b"x")) for _ in range(20_000))]
    sizes = [len(codecs.lzf_compress(t)) for t in texts]
    assert sizes[4] < 30 and sizes[7] < len(texts[7]) // 2
    for block in (codecs.LZF_BLOCK, 7, 100):
        monkeypatch.setattr(codecs, "LZF_BLOCK", block)
        for t in texts:
            packed = codecs.lzf_compress(t)
            assert codecs.lzf_decompress(packed) == t and len(packed) <= len(t) * 33 // 32 + 2
    # references that reach into what they write, and as far back as they can
    assert codecs.lzf_decompress(b"\x00a\xe0\xff\x00") == b"a" * 265
    far = bytes(rng.randrange(256) for _ in range(8192))
    assert codecs.lzf_decompress(codecs.lzf_compress(far + far[:50])) == far + far[:50]
