"""Log lines of several kinds, made in the cluster: each line follows from its number and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .ship import ship

#: 2024-03-04 09:00:00 UTC, in seconds.
BEGIN = 1_709_542_800


def _number(low: int, high: int, salt: str, seed: int) -> Column:
    """A number from ``low`` to ``high``, the same for a line, salt and seed whenever it is asked for."""
    return (F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(high - low + 1)) + low).cast("long")


def _one(values: tuple[str, ...], salt: str, seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), _number(1, len(values), salt, seed).cast("int"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _time(pattern: str, seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), pattern)


def _iso(seconds: Column) -> Column:
    return _time("yyyy-MM-dd'T'HH:mm:ss'Z'", seconds)


def access(seconds: Column, seed: int) -> Column:
    """Requests to a web server."""
    path = _text(_one(("/shop/item/", "/shop/cart/", "/help/page/", "/img/"), "path", seed), _number(1, 5000, "item", seed))
    status = F.when(_number(1, 100, "bad", seed) <= 3, _one(("404", "500", "503"), "status", seed)).otherwise("200")
    address = _text("10.", _number(0, 3, "a", seed), ".", _number(0, 255, "b", seed), ".", _number(1, 254, "c", seed))
    return _text(_iso(seconds), " ", address, " ", _one(("GET", "POST", "HEAD"), "verb", seed), " ", path, " ", status, " ", _number(80, 90_000, "size", seed), "B ", _number(1, 900, "took", seed), "ms")


def syslog(seconds: Column, seed: int) -> Column:
    """Messages of a host's daemons, whose times have no year."""
    what = _number(1, 5, "what", seed)
    who, pid = _text("user", _number(1, 40, "user", seed)), _number(100, 32_000, "pid", seed)
    message = (
        F.when(what == 1, _text("sshd[", pid, "]: accepted key of ", who, " from 10.1.", _number(0, 9, "x", seed), ".", _number(1, 254, "y", seed), " port ", _number(1024, 65_000, "port", seed)))
        .when(what == 2, _text("cron[", pid, "]: (", who, ") runs job number ", _number(1, 99, "job", seed)))
        .when(what == 3, _text("kernel: disk sd", _one(("a", "b", "c"), "disk", seed), " read took ", _number(1, 4000, "read", seed), "ms"))
        .when(what == 4, _text("systemd[1]: unit ", _one(("mail", "web", "queue"), "unit", seed), " entered state ", _one(("active", "failed", "reloading"), "state", seed)))
        .otherwise(_text("dhcpd: lease of 10.2.0.", _number(1, 254, "lease", seed), " ends in ", _number(60, 7200, "ends", seed), "s"))
    )
    return _text(_time("MMM d HH:mm:ss", seconds), " host", _number(1, 12, "host", seed), " ", message)


def multiline(seconds: Column, seed: int) -> Column:
    """Events of which some go on over several lines."""
    frames = F.array_join(F.transform(F.sequence(F.lit(1), _number(2, 6, "depth", seed)), lambda i: F.concat(F.lit("\n\tat app.part"), i.cast("string"), F.lit(".Work.run(Work.src:"), (i * 7).cast("string"), F.lit(")"))), "")
    failed = _number(1, 12, "fails", seed) == 1
    head = _text(_iso(seconds), " ", F.when(failed, "ERROR").otherwise("INFO"), " task ", _number(1, 9999, "task", seed), F.when(failed, " failed: no answer").otherwise(" done"), " after ", _number(1, 9000, "took", seed), "ms")
    return F.when(failed, F.concat(head, frames, F.lit("\nCaused by: closed connection"))).otherwise(head)


def pareto(seconds: Column, seed: int, shapes: int = 200) -> Column:
    """Many shapes of lines, of which a few make up nearly all of them."""
    u = _number(0, 999_999, "u", seed) / 1e6
    shape = F.floor(shapes * u * u * u * u).cast("long")
    word = lambda salt: F.translate(F.substring(F.sha2(_text(shape, salt), 256), 1, 6), "0123456789", "ghijklmnop")
    return _text(_iso(seconds), " ", word("a"), " ", word("b"), " of ", word("c"), " number ", _number(1, 100_000, "n", seed), " ", word("d"))


def incident(seconds: Column, seed: int, share: Column) -> Column:
    """A day's traffic with a fault in it: at 0.4 of the time a new version is rolled out, queries
    slow down, from 0.5 on connections run out and requests fail, at 0.8 it is taken back."""
    ill = share.between(0.5, 0.8)
    fails = ill & (_number(1, 100, "fails", seed) <= 45)
    slow = share.between(0.42, 0.8) & (_number(1, 100, "slow", seed) <= 20)
    event = (
        F.when(F.col("id") == F.floor(F.col("n") * 0.4), "INFO rollout of store version 7.2.0 begins")
        .when(F.col("id") == F.floor(F.col("n") * 0.8), "INFO rollout of store version 7.1.9 begins")
        .when(fails, _text("ERROR store request ", _number(1, 99_999, "r", seed), " failed: connections exhausted, pool_wait=", _number(900, 5000, "w", seed), "ms"))
        .when(slow, _text("WARN slow query on orders took ", _number(800, 6000, "q", seed), "ms"))
        .otherwise(_text("INFO request ", _number(1, 99_999, "r", seed), " answered in ", _number(2, 90, "a", seed), "ms"))
    )
    return _text(_iso(seconds), " ", event)


KINDS = ("access", "syslog", "multiline", "pareto", "incident")


def lines(spark: SparkSession, kind: str, n: int, seed: int = 42, per_second: int = 20, begin: int = BEGIN) -> DataFrame:
    """``(line_no, value)``: ``n`` events of a kind in order, ``per_second`` of them a second."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    rows = ship(spark).range(n).withColumn("n", F.lit(n))
    seconds = (F.lit(begin) + F.floor(F.col("id") / per_second)).cast("long")
    value = incident(seconds, seed, F.col("id") / F.col("n")) if kind == "incident" else globals()[kind](seconds, seed)
    return rows.select(F.col("id").alias("line_no"), value.alias("value"))


def write(spark: SparkSession, kind: str, n: int, path: str, **options) -> None:
    """Write the lines as one ordered set of text files."""
    lines(spark, kind, n, **options).select("value").write.text(path)
