"""Introspection and session operators: the operator catalogue, settings, connections, dumps."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import codecs, scalars
from tessera.operators import keys

#: name, arity (negative: at least), writes, first key, last key, step, summary
OPERATORS = (
    ("get", 2, False, 1, 1, 1, "value of a key"), ("set", -3, True, 1, 1, 1, "set a key, on conditions and with a deadline"), ("strlen", 2, False, 1, 1, 1, "bytes of a value"),
    ("mget", -2, False, 1, -1, 1, "values of many keys"), ("mset", -3, True, 1, -1, 2, "set many keys"), ("del", -2, True, 1, -1, 1, "delete keys"), ("unlink", -2, True, 1, -1, 1, "delete keys"),
    ("exists", -2, False, 1, -1, 1, "count live keys"), ("type", 2, False, 1, 1, 1, "type of a key"), ("touch", -2, False, 1, -1, 1, "refresh access times"), ("ttl", 2, False, 1, 1, 1, "seconds left"),
    ("pttl", 2, False, 1, 1, 1, "milliseconds left"), ("expiretime", 2, False, 1, 1, 1, "deadline in seconds"), ("pexpiretime", 2, False, 1, 1, 1, "deadline in milliseconds"), ("persist", 2, True, 1, 1, 1, "drop a deadline"),
    ("expire", -3, True, 1, 1, 1, "deadline by seconds from now"), ("pexpire", -3, True, 1, 1, 1, "deadline by milliseconds from now"), ("expireat", -3, True, 1, 1, 1, "deadline at a second"), ("pexpireat", -3, True, 1, 1, 1, "deadline at a millisecond"),
    ("rename", 3, True, 1, 2, 1, "move an entry to another name"), ("renamenx", 3, True, 1, 2, 1, "the same if that name is free"), ("copy", -3, True, 1, 2, 1, "copy an entry"), ("move", 3, True, 1, 1, 1, "move an entry to another database"),
    ("keys", 2, False, 0, 0, 0, "keys that match a glob"), ("randomkey", 1, False, 0, 0, 0, "a key by a seeded draw"), ("scan", -2, False, 0, 0, 0, "keys bucket by bucket"), ("object", -2, False, 2, 2, 1, "encoding, references, idle time, frequency"),
    ("dump", 2, False, 1, 1, 1, "sealed value"), ("restore", -4, True, 1, 1, 1, "entry from a sealed value"), ("sort", -2, True, 1, 1, 1, "elements in order of weights"), ("sort_ro", -2, False, 1, 1, 1, "the same without storing"),
    ("command", -1, False, 0, 0, 0, "this catalogue"), ("dbsize", 1, False, 0, 0, 0, "rows of a database"), ("flushdb", -1, True, 0, 0, 0, "empty a database"), ("flushall", -1, True, 0, 0, 0, "empty all"), ("info", -1, False, 0, 0, 0, "figures by database"),
    ("config", -2, False, 0, 0, 0, "settings"), ("ping", -1, False, 0, 0, 0, "answer"), ("echo", 2, False, 0, 0, 0, "the argument"), ("select", 2, False, 0, 0, 0, "choose a database"), ("quit", -1, False, 0, 0, 0, "end a session"),
    ("auth", -2, False, 0, 0, 0, "check a password"), ("hello", -1, False, 0, 0, 0, "session figures"), ("reset", 1, False, 0, 0, 0, "session defaults"), ("client", -2, False, 0, 0, 0, "connections"),
)


#: Operators that answer at once, that need memory, that take keys from their arguments, and that take many shards.
FAST = {"get", "strlen", "mget", "unlink", "exists", "type", "touch", "ttl", "pttl", "expiretime", "pexpiretime", "persist", "expire", "pexpire", "expireat", "pexpireat", "renamenx", "move", "dbsize", "ping", "echo", "select", "quit", "auth", "hello", "reset"}
NEED_MEMORY = {"set", "mset", "copy", "restore", "sort"}
MOVABLE = {"sort", "sort_ro"}
TIPS = {"del": ("request_policy:multi_shard", "response_policy:agg_sum")}
TIPS |= {name: TIPS["del"] for name in ("unlink", "exists", "touch")} | {"mget": ("request_policy:multi_shard",), "mset": ("request_policy:multi_shard", "response_policy:all_succeeded")}
ROW = "name string, arity int, flags array<string>, first_key int, last_key int, step int, acl array<string>, tips array<string>, key_specs array<string>, subcommands array<string>"


def command_info(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The ten fields of each operator, or of those named (a null row for a name that is unknown)."""
    known = {o[0]: o for o in OPERATORS}
    rows = []
    for name in known if names is None else [n.lower() for n in names]:
        if name not in known:
            rows.append((None,) * 10)
            continue
        _, arity, writes, first, last, step, _ = known[name]
        flags = ["write"] if writes else ["readonly"] if first else []
        flags += [flag for flag, members in (("denyoom", NEED_MEMORY), ("fast", FAST), ("movablekeys", MOVABLE)) if name in members]
        rows.append((name, arity, flags, first, last, step, [], list(TIPS.get(name, ())), [], []))
    return spark.createDataFrame(rows, ROW)


def command_count() -> int:
    return len(OPERATORS)


def command_docs(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    return catalogue(spark, names).select("name", "summary")


def catalogue(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(name, arity, writes, first_key, last_key, step, summary) of all operators or of those named, whatever their case."""
    wanted = None if names is None else {n.lower() for n in names}
    rows = [o for o in OPERATORS if wanted is None or o[0] in wanted]
    return spark.createDataFrame(rows, "name string, arity int, writes boolean, first_key int, last_key int, step int, summary string")


@dataclass(frozen=True)
class Settings:
    """What operators take from configuration; ``set_many`` changes all or nothing."""

    port: int = 6379
    databases: int = 16
    shard_count: int = 8
    maxmemory: int = 0
    maxmemory_policy: str = "noeviction"
    maxmemory_samples: int = 5
    lfu_log_factor: int = 10
    lfu_decay_time: int = 1
    notify_keyspace_events: str = ""
    requirepass: str = ""
    appendonly: str = "no"
    appendfsync: str = "everysec"
    timeout: int = 0
    tcp_keepalive: int = 300
    hash_max_listpack_entries: int = 128
    hash_max_listpack_value: int = 64
    list_max_listpack_size: int = 128
    set_max_intset_entries: int = 512
    set_max_listpack_entries: int = 128
    zset_max_listpack_entries: int = 128
    zset_max_listpack_value: int = 64
    proto_max_bulk_len: int = 512 * 1024 * 1024
    save: str = ""

    @staticmethod
    def field(name: str) -> str:
        name = name.lower().replace("-", "_")
        return "shard_count" if name == "shards" else name

    def get(self, name: str) -> str | None:
        name = self.field(name)
        return str(getattr(self, name)) if name in {f.name for f in fields(self)} else None

    def set_many(self, pairs: dict[str, str]) -> Settings:
        changes = {}
        for name, text in pairs.items():
            field = self.field(name)
            now = getattr(self, field, None)
            if now is None:
                raise KeyError(name)
            value = text
            if isinstance(now, int):
                value = scalars.memory_size(text) if field in ("maxmemory", "proto_max_bulk_len") else int(text)
                if value is None:
                    raise ValueError(f"{name}: {text}")
            changes[field] = value
        if (n := changes.get("shard_count")) is not None and (n < 1 or n & (n - 1)):
            raise ValueError("shard-count: not a power of two")
        return replace(self, **changes)


    def reset_statistics(self) -> Settings:
        """Figures are aggregates of tables here, so there is nothing to reset."""
        return self


@dataclass
class Session:
    """A connection's state: database, protocol, name, whether it is allowed in."""

    settings: Settings = Settings()
    db: int = 0
    protocol: int = 2
    name: str = ""
    open: bool = True
    authenticated: bool = False

    def ping(self, message: str | None = None) -> str:
        return "PONG" if message is None else message

    def echo(self, message: str) -> str:
        return message

    def select(self, index: str) -> None:
        if not index.isdigit() or not 0 <= int(index) < self.settings.databases:
            raise ValueError("no such database")
        self.db = int(index)

    def auth(self, password: str, user: str = "default") -> bool:
        import hmac

        self.authenticated = user == "default" and hmac.compare_digest(password.encode(), self.settings.requirepass.encode())
        return self.authenticated

    def hello(self, protocol: int | None = None, name: str | None = None) -> dict[str, object]:
        if protocol not in (None, 2, 3):
            raise ValueError("no such protocol")
        self.protocol, self.name = protocol or self.protocol, name if name is not None else self.name
        return {"server": "tessera", "version": "1", "proto": self.protocol, "id": id(self), "mode": "standalone", "role": "master", "modules": []}

    def reset(self) -> None:
        self.db, self.protocol, self.name, self.authenticated = 0, 2, "", False

    def quit(self) -> None:
        self.open = False


def clients(connections: DataFrame, *, ids: list[int] | None = None, kind: str | None = None, addr: str | None = None, laddr: str | None = None, user: str | None = None, min_age_s: int | None = None, skip: int | None = None) -> DataFrame:
    """Connections (id, addr, laddr, type, user, age_s, ...) that pass all filters given: what a listing shows, or a kill ends; ``skip`` is the id of the caller's own, where that is spared."""
    tests = [
        F.col("id").isin(ids) if ids is not None else None, F.lower("type") == kind.lower() if kind else None, F.col("addr") == addr if addr else None,
        F.col("user") == user if user else None, F.col("age_s") >= min_age_s if min_age_s is not None else None,
        F.col("laddr") == laddr if laddr else None, F.col("id") != skip if skip is not None else None,
    ]
    for test in tests:
        connections = connections if test is None else connections.filter(test)
    return connections


def dump(k: DataFrame, now_ms: int) -> DataFrame:
    """(key, payload) of live string keys: value, version, checksum."""
    return keys.live(k, now_ms).filter("type = 'string'").select("key", codecs.dump_udf()(F.col("val").cast("binary")).alias("payload"))


def restore(payloads: DataFrame, now_ms: int, *, absolute: bool = False) -> DataFrame:
    """(key, val, expire_at_ms, error, and ordinal if given) for (key, ttl_ms, payload): no deadline for 0; a negative time or a broken payload is an error."""
    rows = payloads.withColumn("raw", codecs.restore_udf()("payload"))
    error = F.when(F.col("ttl_ms") < 0, "invalid ttl").when(F.col("raw").isNull(), "bad payload")
    at = F.when(F.col("ttl_ms") > 0, F.col("ttl_ms") + (0 if absolute else now_ms))
    return rows.select(*(c for c in ("ordinal",) if c in payloads.columns), "key", F.when(error.isNull(), F.col("raw").cast("string")).alias("val"), F.when(error.isNull(), at).alias("expire_at_ms"), error.alias("error"))


def restore_into(k: DataFrame, payloads: DataFrame, now_ms: int, *, replace: bool = False, absolute: bool = False, idle_s: int | None = None, freq: int | None = None, db: int = 0) -> tuple[DataFrame, DataFrame]:
    """The keyspace with the entries of (ordinal, key, ttl_ms, payload), and (ordinal, key, error) of each.

    Without ``replace`` a live key is busy, for the second of two commands on it too; with it the last good one counts. A deadline that is past already leaves no key. ``idle_s`` sets the access time that long ago; ``freq`` (0 to 255) is kept where the keyspace
    has such a column.
    """
    if freq is not None and not 0 <= freq <= 255:
        raise ValueError("Invalid FREQ value, must be >= 0 and <= 255")
    if idle_s is not None and idle_s < 0:
        raise ValueError("Invalid IDLETIME value, must be >= 0")
    # both by key and alike, so what follows needs no other exchange
    rows, here = keys.dealt(restore(payloads, now_ms, absolute=absolute), keys.live(k, now_ms))
    mine = here.filter(F.col("db") == db).select("key", F.lit(True).alias("busy"))
    rows = rows.join(mine, "key", "left")
    good = F.col("error").isNull() | F.col("error").contains("payload")
    order = W.partitionBy("key").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    usable = F.col("error").isNull()
    busy = F.lit(False) if replace else good & (F.coalesce("busy", F.lit(False)) | F.coalesce(F.max(usable & (F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") > now_ms))).over(order), F.lit(False)))
    rows = rows.withColumn("error", F.when(busy, "BUSYKEY").otherwise(F.col("error")))
    access = now_ms if idle_s is None else now_ms - idle_s * 1000
    put = keys.latest(rows.filter("error IS NULL"), "key")
    fresh = {"db": F.lit(db), "key": F.col("key"), "type": F.lit("string"), "val": F.col("val"), "expire_at_ms": F.col("expire_at_ms"), "access_ms": F.lit(access).cast("long"), "freq": F.lit(5 if freq is None else freq)}
    new = put.filter(F.col("expire_at_ms").isNull() | (F.col("expire_at_ms") > now_ms)).select(*(fresh[c].alias(c) for c in k.columns))
    kept = here.filter(F.col("db") == db).join(put.select("key"), "key", "left_anti").select(*k.columns)
    return kept.union(here.filter(F.col("db").isNull() | (F.col("db") != db)).select(*k.columns)).union(new), rows.select("ordinal", "key", "error")
