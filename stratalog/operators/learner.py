"""Learning which patterns are one template.

The input is the dimension of distinct patterns, not the lines. Patterns of one token count are
compared position by position: positions that tell meanings apart split the group, positions that
hold identifiers become ``{var}``. Groups of token counts are independent and run side by side.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import masking
from ..work import written

VAR = "{var}"
MAX_BRANCHING = 8
#: Fixed value: above this similarity a line is taken for a template's.
SIMILAR = 0.95
#: Patterns of a group that one Python task takes.
GROUP_ROWS = 20_000
# Fixed value: what tells an identifier from a word.
_ID = re.compile(r"[0-9{}=/\\@#+|~]")
_PIECE = re.compile(r"\{\{|\}\}|\{[^}]*\}")


def key_prefix(values: list[str]) -> str:
    """What all values begin with, up to the last ``=`` or ``:`` of it; nothing if there are braces."""
    low, high = min(values), max(values)
    n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    shared = low[:n]
    if "{" in shared or "}" in shared:
        return ""
    return shared[: max(shared.rfind("="), shared.rfind(":")) + 1]


def learn(patterns: list[str], max_branching: int = MAX_BRANCHING) -> dict[str, str]:
    """Merged patterns by source pattern; patterns that stay as they are, are left out."""
    by_size: dict[int, list[list[str]]] = {}
    for p in sorted(set(patterns)):
        row = p.split(" ")
        by_size.setdefault(len(row), []).append(row)
    work, out = list(by_size.values()), {}
    while work:
        rows = work.pop()
        if len(rows) < 2:
            continue
        values = [set(column) for column in zip(*rows)]
        varying = [j for j, v in enumerate(values) if len(v) > 1]
        meanings = [j for j in varying if len(values[j]) <= max_branching or 2 * sum(_ID.search(v) is not None for v in values[j]) < len(values[j])]
        if meanings:
            at = min(meanings, key=lambda j: (len(values[j]), j))
            split: dict[str, list[list[str]]] = {}
            for row in rows:
                split.setdefault(row[at], []).append(row)
            work.extend(split.values())
            continue
        merged = list(rows[0])
        for j in varying:
            merged[j] = key_prefix(list(values[j])) + VAR
        final = " ".join(merged)
        out.update((" ".join(row), final) for row in rows)
    return out


def plans(patterns: DataFrame, max_branching: int = MAX_BRANCHING, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``patterns(pattern)`` to ``(source_pattern, final_pattern)`` for those that merge.

    Patterns of one token count are a group. As long as a group has more than ``group_rows``
    patterns, Spark finds the position that splits it from the values' counts at every position, and
    splits it by that, or merges it if no position does, however many patterns it has; the groups
    that are small go through the same rules in Python, one at a time.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(learn(group["pattern"].tolist(), max_branching).items()), columns=["source_pattern", "final_pattern"])

    tokens = F.split("pattern", " ", -1)
    rows = patterns.select("pattern").distinct().withColumn("gid", F.size(tokens).cast("long"))
    largest = lambda: rows.groupBy("gid").count().agg(F.max("count")).first()[0] or 0
    done, most = None, largest()
    if most > group_rows:
        rows = written(rows, "patterns")
    while most > group_rows:
        big = written(rows.groupBy(F.col("gid").alias("g")).agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("g"), "groups")
        large = rows.join(big, F.col("gid") == F.col("g"), "left_semi").withColumn("tokens", tokens)
        cells = large.select("gid", F.posexplode("tokens").alias("at", "token")).distinct()
        isid = F.col("token").rlike(_ID.pattern)
        stats = cells.groupBy("gid", "at").agg(F.count("*").alias("n"), F.count_if(isid).alias("ids"), F.min("token").alias("low"), F.max("token").alias("high")).where("n > 1")
        meaning = (F.col("n") <= max_branching) | (F.col("ids") * 2 < F.col("n"))
        stats = written(stats.withColumn("by", F.when(meaning, F.struct("n", "at"))), "positions")
        split = stats.groupBy(F.col("gid").alias("g")).agg(F.min("by").alias("by"))
        marked = large.join(split, F.col("gid") == F.col("g"), "left")
        token = F.get("tokens", F.col("by.at"))
        next_gid = F.when(F.col("by").isNotNull(), F.xxhash64("gid", F.col("by.at"), token))
        merged = stats.join(split.where("by IS NULL").select("g"), F.col("gid") == F.col("g"), "left_semi")
        finals = _prefixed(merged).groupBy(F.col("gid").alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("at", "final"))).alias("finals"))
        out = marked.where("by IS NULL").join(finals, F.col("gid") == F.col("m"))
        final = F.array_join(F.transform("tokens", lambda t, i: F.coalesce(F.try_element_at("finals", i), t)), " ")
        out = written(out.select(F.col("pattern").alias("source_pattern"), final.alias("final_pattern")), "merged")
        done = out if done is None else done.unionByName(out)
        rest = rows.join(big, F.col("gid") == F.col("g"), "left_anti")
        rows = written(rest.unionByName(marked.where("by IS NOT NULL").select("pattern", next_gid.alias("gid"))), "patterns")
        most = largest()
    found = rows.groupBy("gid").applyInPandas(run, "source_pattern string, final_pattern string")
    return found if done is None else found.unionByName(done)


def _prefixed(positions: DataFrame) -> DataFrame:
    """Positions of merged groups, one row for each, with the token that stands there then."""

    def run(batches):
        for b in batches:
            yield b.assign(final=[key_prefix([x, y]) + VAR for x, y in zip(b["low"], b["high"])])

    slim = positions.select("gid", "at", "low", "high")
    return slim.mapInPandas(run, slim.withColumn("final", F.lit("")).schema).select("gid", "at", "final")


def var_tokens(final: str) -> dict[int, str]:
    """The positions of a merged pattern's variable tokens with their prefixes."""
    return {j: t[: -len(VAR)] for j, t in enumerate(final.split(" ")) if t.endswith(VAR) and not set("{}") & set(t[: -len(VAR)])}


def program(source: str, final: str) -> list[dict]:
    """How a line's parameters under ``source`` become those under ``final``: each step takes some
    of them, as they are or filled into the text of a variable token."""
    variable = var_tokens(final) if source != final else {}
    steps, at = [], 1
    for j, token in enumerate(source.split(" ")):
        named = [m.group() for m in _PIECE.finditer(token) if m.group() not in ("{{", "}}")]
        if j in variable:
            texts, text, last = [], "", 0
            rest = token[len(variable[j]) :]
            for m in _PIECE.finditer(rest):
                text += rest[last : m.start()]
                last = m.end()
                if m.group() in ("{{", "}}"):
                    text += m.group()[0]
                else:
                    texts.append(text)
                    text = ""
            steps.append({"var": True, "start": at, "n": len(named), "literals": [*texts, text + rest[last:]]})
        else:
            steps.extend({"var": False, "start": at + k, "n": 1, "literals": []} for k in range(len(named)))
        at += len(named)
    return steps


PROGRAM = "array<struct<var:boolean,start:int,n:int,literals:array<string>>>"


def with_programs(pairs: DataFrame) -> DataFrame:
    """``pairs(source_pattern, final_pattern, ...)``, a dimension, with the parameter program."""
    import json

    def run(batches):
        for b in batches:
            yield b.assign(program=[json.dumps(program(s, f)) for s, f in zip(b["source_pattern"], b["final_pattern"])])

    schema = pairs.withColumn("program", F.lit("").cast("string")).schema
    return pairs.mapInPandas(run, schema).withColumn("program", F.from_json("program", PROGRAM))


def final_params(steps, params):
    """The parameters that a program makes of a line's parameters."""
    def one(p):
        own = F.slice(params, p["start"], p["n"])
        return F.when(p["var"], masking.fill(p["literals"], own)).otherwise(F.get(params, p["start"] - 1))

    return F.transform(steps, one)


def matches(patterns: DataFrame, merged: DataFrame) -> DataFrame:
    """``patterns(pattern)`` that fit a merged template ``merged(template_id, pattern)``, with the
    first such template.

    A pattern and a template are joined on their token count and on the template's longest token
    that is no variable, at its place; then they are compared token by token. Of the places that
    templates of a size are joined by, a pattern has one row each.
    """
    tokens = F.split("pattern", " ", -1)
    left = patterns.select("pattern", tokens.alias("own"), F.size(tokens).alias("size"))
    right = merged.select("template_id", F.col("pattern").alias("final_pattern"), tokens.alias("theirs"), F.size(tokens).alias("size_t")).where(F.exists("theirs", _is_var))
    fixed = F.filter(F.transform("theirs", lambda t, i: F.when(~_is_var(t), F.struct(F.length(t).alias("n"), (-i).alias("at")))), lambda x: x.isNotNull())
    right = right.withColumn("place", F.coalesce(-F.array_max(fixed)["at"], F.lit(-1)))
    right = right.withColumn("word", F.coalesce(F.get("theirs", F.col("place")), F.lit("")))
    places = right.select(F.col("size_t").alias("s"), F.col("place").alias("p")).distinct()
    keyed = left.join(places, F.col("size") == F.col("s")).withColumn("key", F.when(F.col("p") < 0, "").otherwise(F.get("own", F.col("p"))))
    fits = lambda a, b: F.when(_is_var(b), F.startswith(a, F.substring(b, F.lit(1), F.length(b) - len(VAR)))).otherwise(a == b)
    same = (F.col("size") == F.col("size_t")) & (F.col("p") == F.col("place")) & (F.col("key") == F.col("word"))
    joined = keyed.join(right, same & F.forall(F.zip_with("own", "theirs", fits), lambda x: x))
    return joined.groupBy("pattern").agg(F.min_by("final_pattern", "template_id").alias("final_pattern"))


def most_similar(lines: DataFrame, templates: DataFrame, threshold: float = SIMILAR, others: bool = False) -> DataFrame:
    """``lines(id, words)`` with the most similar of ``templates(template_id, words)``, of equally
    similar ones the first, if its share of equal words at equal places is above ``threshold``;
    with ``others``, one of another id.

    So similar a pair has fewer than ``1 - threshold`` of the longer one's words unlike, so it
    shares one of as many first words and one more: the two are joined on those words.
    """

    def keyed(df: DataFrame, own: str) -> DataFrame:
        unlike = F.floor(F.size("words") * (1 - threshold) / threshold + 1e-9).cast("int")
        places = F.sequence(F.lit(0), F.least(unlike, F.size("words") - 1))
        return df.where(F.size("words") > 0).select(own, F.col("words").alias(f"{own}_words"), F.explode(places).alias("at")).withColumn("word", F.get(f"{own}_words", F.col("at")))

    pairs = keyed(lines, "id").join(keyed(templates, "template_id"), ["at", "word"])
    pairs = pairs.where("id <> template_id") if others else pairs
    alike = masking.similarity(F.col("id_words"), F.col("template_id_words")).alias("similarity")
    found = pairs.select("id", "template_id", alike).where(F.col("similarity") > threshold)
    return found.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "template_id")).alias("best")).select("id", "best.template_id", (-F.col("best.s")).alias("similarity"))


def _is_var(t):
    return t.rlike(r"^[^{}]*\{var\}$")
