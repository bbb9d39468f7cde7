"""Secret scans over a trigram inverted index (built-in functions only).

From each rule's regular expression a Boolean trigram query is derived (an OR of ANDs of lower-case trigrams that
every match must contain). The index holds one posting (trigram, document) for each trigram that some query asks
for and that the document contains. A rule's candidates are the documents whose postings meet one of its ANDs;
the expression itself is run on candidates only. Rules without mandatory trigrams are run on every document.

A match counts if it has at least the rule's length (in its group); matches are leftmost and do not overlap within
a rule. Spans are code points, end exclusive. Null texts are empty; repeated rows get equal results; documents are
told apart by a hash of id and text, so null ids are allowed. Postings are rows, never lists, so a frequent trigram
or a large group of copies meets no single task.
"""

from __future__ import annotations

import re._constants as _c
import re._parser as _parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from countloom.llm.common import private


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules come first; their order is that of kinds at one start.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = ("assign", "access", "hex")
#: Most strings that the exact part of an expression may stand for.
MOST = 64


# --- trigram queries: a query is a set of ANDs (frozensets of trigrams), one of which holds; {frozenset()} is "anything"

ANY = frozenset([frozenset()])


def _simplify(query) -> frozenset:
    query = frozenset(query)
    return frozenset(a for a in query if not any(b < a for b in query))


def _and(p, q) -> frozenset:
    return _simplify(a | b for a, b in product(p, q)) if len(p) * len(q) <= MOST else min(p, q, key=len)


def _of(strings) -> frozenset:
    return _simplify(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _exact(node) -> set[str] | None:
    """The lower-cased strings that a node stands for, if they are few."""
    op, arg = node
    if op is _c.LITERAL:
        return {chr(arg).lower()}
    if op is _c.IN and arg and arg[0][0] is not _c.NEGATE:
        out = set()
        for kind, x in arg:
            if kind is _c.LITERAL:
                out.add(chr(x).lower())
            elif kind is _c.RANGE and x[1] - x[0] < 6:
                out |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 6 else None
    if op is _c.SUBPATTERN:
        return _exact_all(arg[-1])
    if op is _c.BRANCH:
        parts = [_exact_all(x) for x in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] is not _c.MAXREPEAT and arg[1] <= 4:
        if (one := _exact_all(arg[2])) is None:
            return None
        out = {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)} if len(one) ** arg[1] <= MOST else None
        return out
    if op is _c.AT:
        return {""}
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        if (part := _exact(node)) is None or len(out) * len(part) > MOST:
            return None
        out = {a + b for a in out for b in part}
    return out


def _query(nodes) -> frozenset:
    query, run = ANY, {""}
    for op, arg in nodes:
        part = _exact((op, arg))
        if part is not None and len(run) * len(part) <= MOST:
            run = {a + b for a in run for b in part}
            continue
        query = _and(query, _of(run))
        run = part if part is not None else {""}
        if part is None:
            if op is _c.SUBPATTERN:
                query = _and(query, _query(arg[-1]))
            elif op is _c.BRANCH:
                query = _and(query, _simplify(x for b in arg[1] for x in _query(b)))
            elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] > 0:
                query = _and(query, _query(arg[2]))
    return _and(query, _of(run))


def trigram_query(pattern: str) -> frozenset:
    """ANDs of mandatory trigrams of ``pattern``, one of which each match contains; ``ANY`` if it has none."""
    query = _simplify(_query(_parser.parse(pattern)))
    return ANY if frozenset() in query else query


# --- index, candidates, verification


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A hash of id and text, under a name that no column has."""
    return docs.select("*", F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"))


def build_index(keyed: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """Postings (trigram, _key) of all trigrams that the rules' queries ask for."""
    grams = sorted({g for r in rules if (q := trigram_query(r.pattern)) != ANY for a in q for g in a})
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    present = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams))) if grams else F.expr("cast(array() as array<string>)")
    return keyed.select("_key", low.alias("_low")).select("_key", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_key, kinds): for each document the rules of which one AND is met by its postings."""
    rows = [(r.kind, i, g, len(a)) for r in rules if (q := trigram_query(r.pattern)) != ANY for i, a in enumerate(sorted(map(sorted, q))) for g in a]
    asked = index.sparkSession.createDataFrame(rows, "kind string, part int, trigram string, need int")
    met = index.join(F.broadcast(asked), "trigram").groupBy("_key", "kind", "part", "need").agg(F.count_distinct("trigram").alias("n"))
    return met.where("n = need").groupBy("_key").agg(F.collect_set("kind").alias("kinds"))


def _matches(rule: Rule, text: Column) -> Column:
    """All matches of a rule: (kind, length of the text before, length of the match, does it count)."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    before = F.split(text, rule.pattern, -1)
    joined = F.arrays_zip(whole.alias("m"), counted.alias("g"), before.alias("b"))
    return F.transform(
        F.filter(joined, lambda x: x["m"].isNotNull()),
        lambda x: F.struct(F.char_length(x["b"]).alias("gap"), F.char_length(x["m"]).alias("size"), (F.char_length(x["g"]) >= rule.least).alias("counts")),
    )


def _found(rows: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    return rows.select("_key", F.lit(rule.kind).alias("kind"), _matches(rule, F.col(text_col)).alias("found")).where(F.size("found") > 0)


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_key, spans): sorted array of (start, rank, kind, end) for each document with a match that counts."""
    keyed = with_key(docs.select(id_col, text_col), id_col, text_col).drop(id_col)
    indexed = [r for r in rules if trigram_query(r.pattern) != ANY]
    full = [r for r in rules if trigram_query(r.pattern) == ANY]
    parts = []
    if indexed:
        asked = keyed.join(candidates(build_index(keyed, rules, text_col=text_col), rules), "_key")
        empty = "cast(array() as array<struct<gap:int,size:int,counts:boolean>>)"
        each = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.when(F.array_contains("kinds", r.kind), _matches(r, F.col(text_col))).otherwise(F.expr(empty)).alias("found")) for r in indexed))
        parts.append(asked.select("_key", F.explode(each).alias("x")).select("_key", "x.kind", "x.found").where(F.size("found") > 0))
    parts += [_found(keyed.where(F.col(text_col).rlike(r.pattern)), r, text_col) for r in full]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rank = F.element_at(F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i)))), F.col("kind"))
    once = rows.dropDuplicates(["_key", "kind"])  # repeated rows have one key
    ended = once.select("_key", "kind", "found", _running("found").alias("ends"))
    each = ended.select("_key", "kind", F.explode(F.arrays_zip("found", "ends")).alias("x")).where("x.found.counts")
    span = F.struct((F.col("x.ends") - F.col("x.found.size")).cast("long").alias("start"), rank.alias("rank"), F.col("kind"), F.col("x.ends").cast("long").alias("end"))
    return each.groupBy("_key").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _running(col: str) -> Column:
    """Running sums of gap + size, in blocks, so that a text with many matches is not summed anew for each."""
    step = 256
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["gap"] + x["size"])
    block = F.transform(F.sequence(F.lit(0), F.floor((F.size(col) - 1) / step).cast("int")), lambda b: F.slice(F.col(col), b * step + 1, F.lit(step)))
    grow = lambda start, xs: F.aggregate(xs, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["gap"] + x["size"])))
    init = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("out"))
    run = F.aggregate(
        block,
        init,
        lambda a, xs: F.struct((a["at"] + total(xs)).alias("at"), F.concat(a["out"], F.array(F.slice(grow(a["at"], xs), 2, step))).alias("out")),
        lambda a: F.flatten(a["out"]),
    )
    return run


@private("_key", "_spans", "_low")
def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans``, a sorted array (empty if there are none)."""
    kept = with_key(docs.drop("secret_spans"), id_col, text_col)
    found = spans(docs, rules, id_col=id_col, text_col=text_col).withColumnRenamed("spans", "_spans")
    empty = F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)")
    return kept.join(found, "_key", "left").withColumn("secret_spans", F.coalesce("_spans", empty)).drop("_key", "_spans")


@private("_key", "_spans", "_low", "_runs", "_edges", "secret_spans")
def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with each run of overlapping or touching spans replaced by ``mark``."""
    found = scan(docs, rules, id_col=id_col, text_col=text_col)
    pair = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    merged = F.aggregate(
        "secret_spans",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(pair(F.element_at(a, -1)["start"], F.greatest(F.element_at(a, -1)["end"], s["end"]))))).otherwise(
            F.concat(a, F.array(pair(s["start"], s["end"])))
        ),
    )
    with_runs = found.withColumn("_runs", F.when(F.size("secret_spans") > 0, merged).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")))
    text = F.col(text_col)
    edges = F.concat(F.array(pair(F.lit(0).cast("long"), F.lit(0).cast("long"))), F.col("_runs"), F.array(pair(F.char_length(text).cast("long"), F.char_length(text).cast("long"))))
    pieces = F.transform(F.sequence(F.lit(1), F.size("_edges") - 1), lambda i: F.substring(text, (F.element_at(F.col("_edges"), i)["end"] + 1).cast("int"), (F.element_at(F.col("_edges"), i + 1)["start"] - F.element_at(F.col("_edges"), i)["end"]).cast("int")))
    return with_runs.withColumn("_edges", edges).withColumn(text_col, F.when(F.size("_runs") > 0, F.array_join(pieces, mark)).otherwise(text)).select(*docs.columns)
