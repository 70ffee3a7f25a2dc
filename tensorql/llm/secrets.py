"""Secret scans over a trigram inverted index. DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: what every match must
contain. The index holds, for each trigram that some query names, the documents whose
lower-cased text contains it. A rule's candidates are the documents in which its postings
intersect as its query asks; only they are searched by the pattern. A rule whose pattern has
no mandatory trigram (hexadecimal runs) is searched for in every document.

Spans are the whole matches of a rule, leftmost and not overlapping within a kind, in code
points, end exclusive. Matches that fail the rule's length are dropped after they are found.

Defined results: null text counts as empty and has no spans. Repeated rows are scanned row by
row; a null id is looked up like any other.
"""

from __future__ import annotations

import re._constants as K
import re._parser as P
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: Characters that this group (0: the match) must have.
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Runs are maximal either way, so this finds just those of [0-9a-f]+ that have 32 or more.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]{1,64}:[^ \t\r\n/@:]{3,128}@"),
)
RULES = BASE + MORE
#: What redaction takes of a private key: all up to its END line; without one, the lines of base64 that follow the header.
_GAP = r"(?:\s|\\[nr])++"
PEM_BLOCK = Rule(
    "pem",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-{1,4}[^-]++)*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}[A-Za-z0-9+/=]{{40,}}+)*+(?:{_GAP}[A-Za-z0-9+/=]++(?=\s*$))?+)",
)
REDACTED = tuple(PEM_BLOCK if r.kind == "pem" else r for r in RULES)

#: A query: all of its clauses hold; a clause holds if all trigrams of one of its sets occur.
Query = list[frozenset[frozenset[str]]]
MOST = 64


def _clause(strings: set[str]) -> frozenset[frozenset[str]] | None:
    """One of these strings occurs. None: this asks for nothing."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return None
    return frozenset(s for s in sets if not any(o < s for o in sets))


def _walk(nodes, query: Query) -> set[str] | None:
    """Adds what the sequence asks for. Returns all that it can match, if that is a small set, else None."""
    exact: set[str] = {""}
    whole = True

    def flush() -> None:
        nonlocal exact, whole
        if clause := _clause(exact):
            query.append(clause)
        exact, whole = {""}, False

    for op, arg in nodes:
        inner: Query = []
        if op is K.LITERAL:
            found = {chr(arg).lower()}
        elif op is K.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                if kind is K.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is K.RANGE and x[1] - x[0] < MOST:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            found = chars if chars and len(chars) <= 6 else None
        elif op is K.BRANCH:
            parts = [_walk(p, []) for p in arg[1]]
            found = None if any(p is None for p in parts) else set().union(*parts)
        elif op is K.SUBPATTERN:
            found = _walk(arg[3], inner)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            least, most, body = arg
            once = _walk(body, inner)
            if least == 0:
                inner = []
            found = {""} | once if (least, most) == (0, 1) and once is not None else None
            if found is None and least and once is not None:  # at least one of the body stands next to what came before
                if len(exact) * len(once) <= MOST:
                    exact = {a + b for a, b in product(exact, once)}
        else:
            found = None
        if found is not None and len(found) * len(exact) <= MOST:
            exact = {a + b for a, b in product(exact, found)}
        else:
            flush()
            query += inner
            if found is not None:
                exact = found
    if not whole:
        flush()
        return None
    return exact


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of every match contains; empty if no trigram is mandatory."""
    query: Query = []
    exact = _walk(P.parse(pattern), query)
    if exact is not None and (clause := _clause(exact)):
        query.append(clause)
    return list(dict.fromkeys(query))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram int, place in the list; doc_id). docs: (doc_id, text)."""
    lower = docs.select("doc_id", F.lower("text").alias("lower"))
    there = F.array(*(F.when(F.contains("lower", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)))
    return lower.select("doc_id", F.explode(F.array_compact(there)).alias("trigram"))


def candidates(index: DataFrame, trigrams: list[str], queries: list[Query]) -> DataFrame:
    """(doc_id, rules): bit r is set if the postings intersect as query r asks. Only documents with such a bit."""
    place = {t: k for k, t in enumerate(trigrams)}
    words = range((len(trigrams) + 62) // 63)
    here = lambda w: F.when(F.expr(f"trigram div 63 = {w}"), F.expr(f"shiftleft(1L, int(trigram % 63))")).otherwise(F.lit(0).cast("long"))
    seen = index.groupBy("doc_id").agg(*(F.bit_or(here(w)).alias(f"seen{w}") for w in words))

    def has(trigram_set) -> Column:
        out = F.lit(True)
        for w in words:
            if need := sum(1 << place[t] % 63 for t in trigram_set if place[t] // 63 == w):
                out &= F.col(f"seen{w}").bitwiseAND(F.lit(need)) == need
        return out

    rules = F.lit(0).cast("long")
    for r, query in enumerate(queries):
        if query:
            holds = F.lit(True)
            for clause in query:
                one = F.lit(False)
                for s in sorted(clause, key=sorted):
                    one |= has(s)
                holds &= one
            rules = rules.bitwiseOR(F.when(holds, F.lit(1 << r).cast("long")).otherwise(F.lit(0).cast("long")))
    return seen.select("doc_id", rules.alias("rules")).where("rules <> 0")


STEP = 64


def _steps(array: str) -> str:
    """SQL: the array in pieces of STEP elements."""
    return f"transform(sequence(0, int(greatest(size({array}) - 1, 0) div {STEP})), c -> slice({array}, c * {STEP} + 1, {STEP}))"


def _spans(text: str, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, stop>> of a rule's matches in the column.

    Matches are placed STEP at a time from the start of their step, and the steps one after the
    other: an array that grows is copied with each addition, so none grows to the number of matches.
    """
    q = "'" + rule.pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found, between = f"regexp_extract_all({text}, {q}, 0)", f"split({text}, {q}, -1)"
    tested = found if rule.group == 0 else f"regexp_extract_all({text}, {q}, {rule.group})"
    zipped = f"transform(arrays_zip({between}, {found}, {tested}), z -> named_struct('gap', length(z.`0`), 'hit', length(z.`1`), 'part', length(z.`2`)))"
    kind = "array<struct<start: bigint, rank: int, stop: bigint>>"
    at = "s.at + x.gap"
    step = (
        f"aggregate(y, named_struct('at', 0L, 'out', cast(array() as {kind})), (s, x) -> named_struct("
        f"'at', {at} + coalesce(x.hit, 0), "
        f"'out', if(x.part >= {rule.least}, concat(s.out, array(named_struct('start', {at}, 'rank', {rank}, 'stop', {at} + x.hit))), s.out)))"
    )
    # array(..)[0] names the zipped matches, so that they are found once
    return F.expr(
        f"flatten(aggregate(transform(transform(array({zipped}), z -> {_steps('z')})[0], y -> {step}), "
        f"named_struct('at', 0L, 'out', cast(array() as array<{kind}>)), (s, x) -> named_struct("
        "'at', s.at + x.at, 'out', if(size(x.out) = 0, s.out, concat(s.out, array(transform(x.out, o -> named_struct("
        "'start', o.start + s.at, 'rank', o.rank, 'stop', o.stop + s.at)))))), s -> s.out))"
    )


def _with_spans(own: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """own: (doc_id, text not null, more). Adds spans array<struct<start, rank, stop>>, by start, then by the rules' order."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for clause in q for s in clause for t in s})
    # Written, so that its size is known: Spark sends it to all only if it is below spark.sql.autoBroadcastJoinThreshold.
    found, _ = C.materialize(candidates(postings(own, trigrams), trigrams, queries), "candidates")
    found = found.select(F.col("doc_id").alias("found_id"), "rules")
    joined = own.join(found, own.doc_id.eqNullSafe(found.found_id), "left").drop("found_id")
    none = F.expr("cast(array() as array<struct<start: bigint, rank: int, stop: bigint>>)")
    spans = []
    for r, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        searched = F.expr(f"(rules & {1 << r}L) <> 0") if query else F.rlike("text", F.lit(rule.pattern))
        spans.append(F.when(searched, _spans("text", rule, r)).otherwise(none))
    return joined.withColumn("spans", F.array_sort(F.concat(*spans))).drop("rules")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text, spans) per row of docs."""
    return _with_spans(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), rules)


def _listed(spans: str, rules: tuple[Rule, ...]) -> str:
    kinds = "array(" + ", ".join(f"'{r.kind}'" for r in rules) + ")"
    return f"array_join(transform({spans}, x -> concat({kinds}[x.rank], ':', x.start, ':', x.stop)), ',')"


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = f"filter(spans, x -> x.rank < {len(BASE)})"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, x -> x.rank = {r})) as bigint)").alias(f"n_{rule.kind}") for r, rule in enumerate(BASE)),
        F.expr(f"sha2({_listed(base, RULES)}, 256)").alias("base_sha256"),
        F.expr(_listed("spans", RULES)).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = REDACTED, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in the text replaced by a mark; overlapping spans become one mark. No row is dropped.

    Where the text is null or has no secret, it stays as it is.
    """
    row = F.struct(*(C.col(c) for c in docs.columns))  # carried through the scan: nothing has to be joined back
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row.alias("row"))
    found = _with_spans(own, rules)
    # As above by steps of spans, each with its own stretch of text: from its first span (the first step: from the beginning)
    # to the next step's. `most` are the furthest ends of the steps.
    steps = (
        f"transform({_steps('spans')}, (p, c) -> named_struct('part', p, 'c', c, 'lo', if(c = 0, 0L, p[0].start), "
        f"'hi', coalesce(get(spans, (c + 1) * {STEP}).start, length(text))))"
    )
    most = f"transform({_steps('spans')}, p -> array_max(transform(p, x -> x.stop)))"
    piece = (
        "aggregate(y.part, named_struct('at', greatest(y.lo, coalesce(array_max(slice(most, 1, y.c)), 0L)), 'out', ''), (s, x) -> if(x.stop <= s.at, s, "
        "named_struct('at', x.stop, 'out', concat(s.out, if(x.start < s.at, '', "
        f"concat(substring(y.own, int(s.at - y.lo + 1), int(x.start - s.at)), '{mark}'))))), "
        "s -> concat(s.out, if(s.at < y.hi, substring(y.own, int(s.at - y.lo + 1), int(y.hi - s.at)), '')))"
    )
    found = found.withColumn("most", F.when(F.size("spans") > 0, F.expr(most)))
    with_text = f"transform({steps}, y -> named_struct('part', y.part, 'c', y.c, 'lo', y.lo, 'hi', y.hi, 'own', substring(text, int(y.lo + 1), int(y.hi - y.lo))))"
    clean = F.expr(f"array_join(transform({with_text}, y -> {piece}), '')")
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("row").getField(text_col))
    return found.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def _sql() -> str:
    """The same spans by DuckDB: every rule over every text."""
    parts = []
    for r, rule in enumerate(RULES):
        q = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(
            f"select doc_id, {r} as rank, '{rule.kind}' as kind, i, g, m, p from (select doc_id, regexp_extract_all(t, {q}, 0) as m, "
            f"regexp_extract_all(t, {q}, {rule.group}) as g, string_split_regex(t, {q}) as p from d), unnest(range(1, len(m) + 1)) as u(i) "
            f"where length(g[i]) >= {rule.least}"
        )
    start = "coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    listed = lambda which: f"coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, rank){which}, '')"
    counts = ", ".join(f"count(*) filter (rank = {r}) as n_{rule.kind}" for r, rule in enumerate(BASE))
    return (
        f"with d as (select doc_id, coalesce(text, '') as t from documents), s as ({' union all '.join(parts)}), "
        f"f as (select doc_id, rank, kind, cast({start} as bigint) as a, length(m[i]) as n from s) "
        f"select d.doc_id, {counts}, sha256({listed(f' filter (rank < {len(BASE)})')}) as base_sha256, {listed('')} as spans "
        "from d left join f using (doc_id) group by d.doc_id"
    )


OP9_SQL = _sql()
