r"""Quality rules as weak supervision, with DataFrame functions alone.

Seven rules look at statistics of a whole text and vote good (1), bad (-1) or abstain (0). Expectation-
maximisation over the counts of vote patterns (at most 3**7, whatever the corpus) estimates for each rule how
often it votes good on good documents and bad on bad ones; the posterior probability of quality replaces
"all rules must pass". The fold runs as one SQL aggregate() over the pattern counts in a single row, so the
corpus is read once for the statistics and the verdicts return by a join on the pattern.

Defined results: a null text has no words; a text without words fails the base rules and is not kept; long
texts are treated whole; repeated rows each get their row; an empty table gives an empty result; columns of
docs besides id and text are untouched, internal names start with __qr_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.shared import fresh
from shelfgraph.session import written

SPACE = r"[\x20\x09-\x0D]+"
RULES = ("symbols", "repeats", "lines", "word_length", "capitals", "variety", "letters")
ITERATIONS = 25
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_distinct")


def _left(text: str, keep: str) -> str:
    """Characters of text in the class keep."""
    return rf"length(regexp_replace({text}, r'[^{keep}]+', ''))"


def _repeat_words(windows: str) -> str:
    """Words in the windows whose hash occurs twice or more: sort (hash, position), mark neighbours, sum the cover."""
    return f"""
    CASE WHEN size({windows}) = size(array_distinct({windows})) THEN 0L ELSE
      aggregate(
        transform(array(array_sort(transform({windows}, (h, i) -> named_struct('h', h, 'i', i)))), a ->
          array_sort(transform(filter(a, (e, j) ->
              (j > 0 AND get(a, j - 1).h = e.h) OR (j < size(a) - 1 AND get(a, j + 1).h = e.h)), e -> e.i)))[0],
        named_struct('e', 0, 'n', 0L),
        (s, p) -> named_struct('e', p + 8, 'n', s.n + least(8, p + 8 - s.e)), s -> s.n) END"""


def with_stats(docs: DataFrame, text: str = "text", prefix: str = "__qr_") -> DataFrame:
    """docs with the columns STATS, each named with prefix, as long."""
    p = prefix
    df = docs.withColumn(f"{p}text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(f"{p}trimmed", F.expr(rf"regexp_replace({p}text, r'^{SPACE}|{SPACE}\z', '')"))
    df = df.withColumn(f"{p}words", F.expr(rf"CASE WHEN {p}trimmed = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split({p}trimmed, r'{SPACE}') END"))
    df = df.withColumn(f"{p}lines", F.expr(rf"filter(split({p}text, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')"))
    window = ", ".join(f"get({p}words, i + {j})" for j in range(8))  # slice() would copy the whole array for each window
    df = df.withColumn(f"{p}windows", F.expr(f"CASE WHEN size({p}words) < 8 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size({p}words) - 8), i -> xxhash64({window})) END"))
    stats = {
        "n_words": f"size({p}words)",
        "word_chars": f"length(array_join({p}words, ''))",
        "n_symbols": _left(f"{p}text", "#*$%&|<>"),
        "n_dup_lines": f"size({p}lines) - size(array_distinct({p}lines))",
        "n_repeat_words": _repeat_words(f"{p}windows"),
        "n_lines": f"size({p}lines)",
        "n_capitals": _left(f"{p}text", r"\p{Lu}"),
        "n_letters": _left(f"{p}text", r"\p{L}\p{M}"),
        "n_distinct": f"size(array_distinct({p}words))",
    }
    df = df.withColumns({f"{p}{k}": F.expr(f"CAST({v} AS BIGINT)") for k, v in stats.items()})
    return df.drop(f"{p}text", f"{p}trimmed", f"{p}words", f"{p}lines", f"{p}windows")


def votes(p: str = "__qr_") -> Column:
    """The rules' votes as an array of RULES' length."""
    rule = lambda bad, good: f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"
    n, share = f"{p}n_words", lambda a, b: f"({p}{a} / greatest({p}{b}, 1))"
    each = (
        rule(f"{share('n_symbols', 'n_words')} > 0.2", f"{share('n_symbols', 'n_words')} <= 0.05"),
        rule(f"{share('n_repeat_words', 'n_words')} > 0.3", f"{share('n_repeat_words', 'n_words')} <= 0.1"),
        rule(f"{share('n_dup_lines', 'n_lines')} > 0.3", f"{share('n_dup_lines', 'n_lines')} <= 0.1"),
        rule(f"{share('word_chars', 'n_words')} NOT BETWEEN 2 AND 14", f"{share('word_chars', 'n_words')} BETWEEN 3 AND 10"),
        rule(f"{share('n_capitals', 'n_letters')} > 0.4", f"{share('n_capitals', 'n_letters')} <= 0.15"),
        rule(f"{n} BETWEEN 20 AND 2000 AND {share('n_distinct', 'n_words')} < 0.2", f"{share('n_distinct', 'n_words')} >= 0.4"),
        rule(f"{n} >= 60 AND {share('n_letters', 'word_chars')} < 0.88", f"{share('n_letters', 'word_chars')} >= 0.93"),
    )
    return F.expr(f"CAST(array({', '.join(each)}) AS ARRAY<INT>)")


def base_failed(p: str = "__qr_") -> Column:
    return F.expr(f"{p}n_words < 20 OR 100 * {p}n_repeat_words > 30 * {p}n_words")


def _posterior(s: str) -> str:
    """Probability that the document of pattern q is good, under the parameters s."""
    ratio = f"zip_with(q.v, zip_with({s}.a, {s}.b, (a, b) -> named_struct('a', a, 'b', b)), (v, r) -> CASE v WHEN 1 THEN ln(r.a) - ln(1D - r.b) WHEN -1 THEN ln(1D - r.a) - ln(r.b) ELSE 0D END)"
    return f"1D / (1D + exp(-(ln({s}.pi) - ln(1D - {s}.pi) + aggregate({ratio}, 0D, (x, y) -> x + y))))"


def patterns(voted: DataFrame, v: str = "__qr_votes", iterations: int = ITERATIONS) -> DataFrame:
    """(votes, posterior, n) of each vote pattern that occurs.

    Accuracies start at 0.95 on good and 0.3 on bad documents and stay within 0.5 .. 0.999 and 0.05 .. 0.999;
    the share of good documents stays within 0.5 .. 0.99, so the classes can't change places. One document's
    worth of the starting accuracy is kept as a prior.
    """
    counts = voted.groupBy(F.col(v).alias("v")).agg(F.count("*").alias("n"))
    ordered = counts.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"))
    k = len(RULES)
    total = "aggregate(w, 0D, (x, q) -> x + q.n)"
    good = "aggregate(w, 0D, (x, q) -> x + q.n * q.g)"
    on = lambda sign, cls: f"aggregate(w, 0D, (x, q) -> x + CASE WHEN get(q.v, r) {sign} THEN q.n * {cls} ELSE 0D END)"
    step = f"""transform(array(transform(p, q -> named_struct('v', q.v, 'n', CAST(q.n AS DOUBLE), 'g', {_posterior("s")}))), w -> named_struct(
      'pi', least(0.99D, greatest(0.5D, {good} / greatest(1D, {total}))),
      'a', transform(sequence(0, {k - 1}), r -> least(0.999D, greatest(0.5D, ({on("= 1", "q.g")} + 0.95D) / ({on("<> 0", "q.g")} + 1D)))),
      'b', transform(sequence(0, {k - 1}), r -> least(0.999D, greatest(0.05D, ({on("= -1", "(1D - q.g)")} + 0.3D) / ({on("<> 0", "(1D - q.g)")} + 1D))))
    ))[0]"""
    start = f"named_struct('pi', 0.8D, 'a', transform(sequence(0, {k - 1}), r -> 0.95D), 'b', transform(sequence(0, {k - 1}), r -> 0.3D))"
    fitted = ordered.withColumn("s", F.expr(f"aggregate(sequence(1, {iterations}), {start}, (s, i) -> {step})"))
    return fitted.select(F.explode(F.expr(f"transform(p, q -> named_struct('votes', q.v, 'n', q.n, 'posterior', {_posterior('s')}))")).alias("x")).select("x.*")


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, STATS, votes, posterior, base_failed, kept for each row. The statistics are written to the shared folder once."""
    base = docs.select(F.col(doc_id).alias("__qr_id"), F.col(text).alias("__qr_source"))
    stats = with_stats(base, "__qr_source").drop("__qr_source")
    stats = written(stats.withColumn("__qr_votes", votes()), "quality-stats")
    fitted = patterns(stats)
    # at most 3 ** len(RULES) patterns
    out = stats.join(F.broadcast(fitted), stats["__qr_votes"].eqNullSafe(fitted["votes"]))
    return out.select(
        F.col("__qr_id").alias(doc_id), *[F.col(f"__qr_{k}").alias(k) for k in STATS], "votes", "posterior",
        base_failed().alias("base_failed"), (~base_failed() & (F.col("posterior") >= 0.5)).alias("kept"),
    )


def keep_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that score_documents would keep, with docs' columns. Statistics are computed in two passes, so no text is shuffled or written."""
    p = fresh(docs, "__qr_")
    # the base rules join the key: as a filter they would be pushed below the projections, which copies their expressions many times
    key = F.array_append(f"{p}votes", base_failed(p).cast("int")).alias(f"{p}key")
    stats = with_stats(docs, text, p).withColumn(f"{p}votes", votes(p)).select(*docs.columns, f"{p}votes", key)
    fitted = written(patterns(stats.select(f"{p}votes"), f"{p}votes"), "quality-patterns").where("posterior >= 0.5")
    good = fitted.select(F.array_append("votes", F.lit(0)).alias(f"{p}good"))
    return stats.join(F.broadcast(good), stats[f"{p}key"] == good[f"{p}good"], "left_semi").select(*docs.columns)
