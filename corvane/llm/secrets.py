"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base spans come from three patterns. The method adds spans of kind `owned`: long mixed
tokens that no pattern names. How live they look is decided by the corpus: the hash of
each candidate is counted over distinct repositories (documents) and owners (sources).
What many owners or many repositories carry is a copied example; what is particular to few
of both is taken for a credential and reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed patterns and least lengths of the base kinds, in the order that ties are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA and more, 18 characters or over
HEX = r"[0-9a-f]{16,}"
ASSIGN_MIN = 12
KINDS = ("assign", "access", "hex", "owned")
#: Candidates of the added kind: long runs that mix lower case, upper case and digits.
OWNED = r"[A-Za-z0-9+/_-]{24,}"
OWNED_MIX = r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"

#: Places in code points (start, end) and in bytes (first, stop); sorted by start, then kind.
SPANS = "array<struct<start: int, rank: int, end: int, first: int, stop: int, value: string>>"


# The expressions below are SQL text: nested lambdas are built far faster from text than call by call.


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once, however often the body reads it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(values: str, combine: str, zero: int) -> str:
    """For each element of an array of whole numbers, all elements up to it combined.

    ``combine``: SQL of {a} and {b}. A fold that appends copies what it has; so the array is
    folded in blocks of about the square root of its size, and then the blocks' last values.
    """
    step = "cast(ceil(sqrt(size(_v))) AS int)"

    def fold(block: str) -> str:
        both = combine.format(a=f"coalesce(try_element_at(_d, -1), {zero})", b="_x")
        return f"aggregate({block}, cast(array() AS array<int>), (_d, _x) -> concat(_d, array({both})))"

    lifted = _let(
        "_b", f"concat(array({zero}), {fold('transform(_p, _q -> element_at(_q, -1))')})",
        f"flatten(transform(_p, (_q, _i) -> transform(_q, _x -> {combine.format(a='_b[_i]', b='_x')})))",
    )
    blocked = _let("_p", f"transform(sequence(0, size(_v) - 1, {step}), _at -> {fold(f'slice(_v, _at + 1, {step})')})", lifted)
    return _let("_v", values, f"if(size(_v) > 0, {blocked}, cast(array() AS array<int>))")


SUM, MAX, MIN = "{a} + {b}", "greatest({a}, {b})", "least({a}, {b})"
LARGEST = (1 << 31) - 1


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, test: str, pattern: str, rank: int, value: str = "_x.m") -> str:
    """All leftmost non-overlapping matches, looked for only where the cheap ``test`` finds that there can be any.

    The pieces between the matches give the gaps, the matches their lengths; their sums are
    the places. ``value``: what to keep of the match _x.m.
    """
    matches, gaps = f"regexp_extract_all({text}, {_quoted(pattern)}, 0)", f"split({text}, {_quoted(pattern)}, -1)"  # one gap more than matches
    pairs = f"zip_with({matches}, {gaps}, (_m, _g) -> named_struct('m', _m, 'g', _g))"
    ends = running("transform(_f, _x -> length(_x.g) + length(_x.m))", SUM, 0)
    stops = running("transform(_f, _x -> octet_length(_x.g) + octet_length(_x.m))", SUM, 0)
    span = f"named_struct('start', _e.e - length(_x.m), 'rank', {rank}, 'end', _e.e, 'first', _e.o - octet_length(_x.m), 'stop', _e.o, 'value', {value})"
    both = f"zip_with({ends}, {stops}, (_e, _o) -> named_struct('e', _e, 'o', _o))"
    placed = f"zip_with(_f, {both}, (_x, _e) -> {span})"
    found = _let("_f", f"filter({pairs}, _x -> _x.m IS NOT NULL)", placed)
    return f"if({test}, {found}, cast(array() AS {SPANS}))"


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def _apart(spans: str) -> str:
    """Sorted spans without those of kind `owned` that overlap one of the base kinds."""
    reach = running(f"transform({spans}, _x -> if(_x.rank < 3, _x.end, 0))", MAX, 0)
    ahead = running(f"reverse(transform({spans}, _x -> if(_x.rank < 3, _x.start, {LARGEST})))", MIN, LARGEST)
    free = f"zip_with({reach}, reverse({ahead}), (_r, _a) -> named_struct('r', _r, 'a', _a))"
    marked = f"zip_with({spans}, {free}, (_s, _y) -> if(_s.rank < 3 OR (_y.r <= _s.start AND _y.a >= _s.end), _s, NULL))"
    return f"filter({marked}, _x -> _x IS NOT NULL)"


def candidate_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_spans``: sorted spans of the three patterns and candidates of kind `owned` that overlap none of them."""
    assign = _spans("_t", "_t RLIKE '(?i)passw|secret|token|api_?key'", ASSIGN, 0, f"regexp_extract(_x.m, {_quoted(ASSIGN)}, 2)")
    assign = f"filter({assign}, _x -> length(_x.value) >= {ASSIGN_MIN})"
    access = _spans("_t", "contains(_t, 'AKIA')", ACCESS, 1)
    hexes = _spans("_t", f"_t RLIKE {_quoted(HEX)}", HEX, 2)
    more = f"filter({_spans('_t', f'_t RLIKE {_quoted(OWNED)}', OWNED, 3)}, _x -> _x.value RLIKE {_quoted(OWNED_MIX)})"
    found = _let("_all", f"array_sort(concat({assign}, {access}, {hexes}, {more}))", f"if(exists(_all, _x -> _x.rank = 3) AND exists(_all, _x -> _x.rank < 3), {_apart('_all')}, _all)")
    return docs.withColumn("_spans", F.expr(_let("_t", f"coalesce(`{text}`, '')", found)))


def ownership(found: DataFrame) -> DataFrame:
    """found(hash, repo, owner): distinct repositories and owners of each hash; null repositories don't count.

    Distinct pairs first, so a hash in a third of all rows meets its counter as one partial
    count from each task.
    """
    return found.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))


def scan_secrets(docs: DataFrame, example_owners: int = 3, owner: str = "source", keep: list[str] | None = None, example_repos: int = 20) -> DataFrame:
    """Secrets in docs(doc_id, text, source): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example.

    One row for each row of ``docs``, repeated rows included. A null text counts as empty,
    and an empty text has no spans (the hash is that of the empty text). A value is a copied
    example if at least ``example_owners`` owners or at least ``example_repos`` repositories
    carry it; else it looks live. All rows without an owner count as one owner, of the empty
    name; rows without an id count as no repository. n_live and n_example count a document's
    spans of either kind. An empty table gives no rows. Columns named in ``keep`` are returned
    too, and ``live`` then holds the spans of live-looking credentials in order (null where
    there are none).
    """
    spark = docs.sparkSession
    extra = [c for c in keep or [] if c != "doc_id"]
    source = F.col(owner) if owner in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id"), F.coalesce(source.cast("string"), F.lit("")).alias("_owner"), "text", *[F.col(c).alias(f"_keep_{c}") for c in extra])
    scanned, _ = common.staged(candidate_spans(rows).withColumn("_row", F.monotonically_increasing_id()).drop("text"), "secrets")
    each = scanned.where(F.size("_spans") > 0).select("_row", F.col("doc_id").alias("repo"), F.col("_owner").alias("owner"), F.explode("_spans").alias("s"))
    each = each.withColumn("hash", F.xxhash64(F.col("s.value")))
    widely = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    copied, copied_path = common.staged(ownership(each).where(widely).select("hash"), "copied")
    judged = common.keyed_join(each, copied.withColumn("_copied", F.lit(True)), copied.count(), 40, ["hash"], "left")
    judged = judged.withColumn("copied", F.coalesce("_copied", F.lit(False)))
    by_row, _ = common.staged(
        judged.groupBy("_row").agg(
            F.array_sort(F.collect_list(F.when((F.col("s.rank") < 3) | ~F.col("copied"), F.col("s")))).alias("_all"),
            F.array_sort(F.collect_list(F.when(~F.col("copied"), F.col("s")))).alias("_live"),
            F.count_if(F.col("copied")).alias("n_example"),
        ),
        "judged",
    )
    common.drop_path(spark, copied_path)
    n_rows, n_spans = by_row.agg(F.count("*"), F.coalesce(F.sum(F.size("_all") + F.size("_live")), F.lit(0))).first()
    out = scanned.join(common.small(by_row, n_rows + n_spans, 150), "_row", "left")
    spans = F.coalesce(F.col("_all"), F.lit([]).cast(SPANS))
    base = F.filter("_spans", lambda s: s["rank"] < 3)

    def count(rank: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")

    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"), count(3).alias("n_owned"),
        F.size(F.coalesce("_live", F.array())).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
        *([F.col("_live").alias("live")] if extra else []), *[F.col(f"_keep_{c}").alias(c) for c in extra],
    )


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text column with each of the sorted spans replaced by a mark; spans that overlap share one. A null list changes nothing."""
    reach = running("transform(_l, _x -> _x.stop)", MAX, 0)
    piece = f"if(_s.first >= _r[_i], concat(cast(substring(_data, _r[_i] + 1, _s.first - _r[_i]) AS string), {_quoted(mark)}), '')"
    rest = "cast(substring(_data, element_at(_r, -1) + 1, octet_length(_data)) AS string)"
    joined = _let("_r", f"concat(array(0), {reach})", f"array_join(concat(transform(_l, (_s, _i) -> {piece}), array({rest})), '')")
    whole = _let("_data", f"cast(`{text}` AS binary)", _let("_l", f"`{spans}`", joined))
    return F.expr(f"CASE WHEN `{spans}` IS NULL THEN `{text}` ELSE {whole} END")
