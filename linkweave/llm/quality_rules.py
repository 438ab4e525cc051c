"""Quality rules by weak supervision, in built-in functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a text's statistics. A label model with one rate of
bad votes in good and one in bad texts for each rule is fitted by expectation-maximisation on the counts
of vote patterns, of which there are at most 3**11 whatever the corpus. The rates have beta priors whose
weight is a part of the corpus, so they mean the same at every size, and no bounds. A text is kept if the posterior
probability of good reaches ``cut``, so one failed rule no longer decides. The base limits (few words,
repeated 5-word windows) still reject.

Windows and words are compared by 64-bit hashes within one text.

Defined cases: null and wordless texts have zero statistics, fail the base and are not kept; texts of
fewer than five words have no windows; rows that repeat are each returned; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.support import settle

WHITE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rules:
    """alarm, detect: prior means of a rule's share of bad votes in good and in bad texts; strength: weight
    of the first prior in parts of all texts, of which the second has a tenth."""

    least_words: int = 10
    repeat_percent: int = 20
    rounds: int = 25
    alarm: float = 0.01
    detect: float = 0.2
    strength: float = 0.02
    cut: float = 0.5


#: Frequent function words of English, German, French and Spanish, lower case.
FUNCTION_WORDS = (
    "the and of to a in that is was for it with as on be at by this from or an are not have had "
    "der die das und ist nicht ein eine zu den von mit sich auf für im dem des auch es "
    "le la les un une et est de du des que pas pour dans en sur au par ce il elle "
    "el los las una y que no por con para su se del al lo como más o"
).split()

#: (name, bad if, good if); what is neither abstains. All are over the statistics below.
RULES: tuple[tuple[str, str, str], ...] = (
    ("symbols", "n_symbols - n_bars > 0.1 * n_words", "n_symbols - n_bars <= 0.02 * n_words"),
    ("bars", "n_bars > 0.1 * n_words", "n_bars <= 0.02 * n_words"),
    ("function words", "n_words >= 20 AND n_function < 0.02 * n_words", "n_function >= 0.08 * n_words"),
    ("shouts", "n_shouts > 0.2 * n_words", "n_shouts <= 0.02 * n_words"),
    ("capitals", "n_capitals > 0.3 * n_words", "n_capitals <= 0.1 * n_words"),
    ("stutter", "n_again > 0.2 * n_words", "n_again <= 0.02 * n_words"),
    ("variety", "n_words >= 50 AND n_distinct < 0.2 * n_words", "n_distinct >= 0.4 * n_words"),
    ("windows", "n_repeat_words > 0.1 * n_words", "n_repeat_words <= 0.02 * n_words"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0 AND n_lines > 1"),
    ("length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    ("ends", "n_ended < 0.2 * n_lines", "n_ended >= 0.8 * n_lines"),
)


def _count(text: Column, characters: str) -> Column:
    """How often the ASCII characters occur; a plain byte search for each is faster than a pattern."""
    left = F.octet_length(text)
    total = F.lit(0)
    for c in characters:
        total = total + (left - F.octet_length(F.replace(text, F.lit(c), F.lit(""))))
    return total.cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each row, all of one pass over the text."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = base.select(
        "doc_id",
        "t",
        F.filter(F.split("t", WHITE), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = split.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    windows = hashed.withColumn(
        "win",
        F.expr("IF(size(h) < 5, array(), transform(sequence(4, size(h) - 1), i -> xxhash64(h[i - 4], h[i - 3], h[i - 2], h[i - 1], h[i])))"),
    )
    # Most texts repeat no window; only those that do are sorted.
    dup = windows.withColumn(
        "sorted",
        F.expr("CASE WHEN size(array_distinct(win)) < size(win) THEN sort_array(transform(win, (x, i) -> struct(x AS x, i AS i))) END"),
    ).withColumn(
        "starts",
        F.expr(
            "CASE WHEN sorted IS NOT NULL THEN sort_array(transform(filter(sorted, (s, k) -> "
            "(k > 0 AND sorted[greatest(k - 1, 0)].x = s.x) OR (k < size(sorted) - 1 AND sorted[least(k + 1, size(sorted) - 1)].x = s.x)), s -> s.i)) END"
        ),
    )
    t = F.col("t")
    return dup.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        (F.length("t") - _count(t, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        _count(t, "#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(
            F.expr("aggregate(starts, struct(0 AS n, 0 AS upto), (a, s) -> struct(a.n + s + 5 - greatest(s, a.upto) AS n, s + 5 AS upto), a -> a.n)"),
            F.lit(0),
        ).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;][\"')]*[\x20\x09-\x0D]*$"))).alias("n_ended"),
        _count(t, "!").alias("n_shouts"),
        _count(t, "|").alias("n_bars"),
        F.size(F.filter("h", lambda x: x.isin(*[F.xxhash64(F.lit(w)) for w in dict.fromkeys(FUNCTION_WORDS)]))).alias("n_function"),
        F.size(F.filter("w", lambda w: ((w < "a") | (w >= "{")) & (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))).alias("n_capitals"),
        F.expr("size(filter(h, (x, i) -> i > 0 AND x = h[greatest(i - 1, 0)]))").alias("n_again"),
        F.size(F.array_distinct("h")).alias("n_distinct"),
    )


def votes() -> Column:
    """The rules' votes, in order."""
    return F.array(*[F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for _, bad, good in RULES])


def _fitted(patterns: DataFrame, p: Rules) -> tuple[DataFrame, str]:
    """One row of the patterns p and the fitted state s, and the posterior of a pattern q as an expression.

    The fit is one fold over the rounds in a single row: the state is the share of good texts and the
    rates of bad votes, among votes, in good (a) and in bad (b) texts.
    """
    r = len(RULES)
    table = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
    log_odds = (
        "ln(s.pi / (1 - s.pi)) + aggregate(sequence(0, {last}), 0D, (x, j) -> x + CASE q.votes[j] "
        "WHEN -1 THEN ln(s.a[j] / s.b[j]) WHEN 1 THEN ln((1 - s.a[j]) / (1 - s.b[j])) ELSE 0D END)"
    ).format(last=r - 1)
    post = f"1 / (1 + exp(- ({log_odds})))"
    # The first posteriors count bad votes: none, one, more.
    first = "CASE size(filter(q.votes, v -> v = -1)) WHEN 0 THEN 0.95D WHEN 1 THEN 0.3D ELSE 0.05D END"

    def total(weight: str, test: str) -> str:
        return f"aggregate(sequence(0, size(p) - 1), 0D, (x, k) -> x + IF({test}, p[k].n * {weight}, 0D))"

    def rates(good: bool) -> str:
        weight = "w[k]" if good else "(1 - w[k])"
        prior = f"{p.strength if good else p.strength / 10}D * {total('1D', 'true')}"
        mean = p.alarm if good else p.detect
        return f"transform(sequence(0, {r - 1}), j -> ({total(weight, 'p[k].votes[j] = -1')} + {mean}D * {prior}) / ({total(weight, 'p[k].votes[j] <> 0')} + {prior}))"

    state = (
        "named_struct('pi', least(0.98D, greatest(0.02D, "
        f"{total('w[k]', 'true')} / {total('1D', 'true')})), 'a', {rates(True)}, 'b', {rates(False)})"
    )
    step = f"transform(array(transform(p, q -> {post})), w -> {state})[0]"
    start = f"transform(array(transform(p, q -> {first})), w -> {state})[0]"
    fitted = table.where("size(p) > 0").withColumn("s0", F.expr(start)).withColumn("s", F.expr(f"aggregate(sequence(1, {p.rounds}), s0, (s, i) -> {step})"))
    return fitted, post


def posteriors(patterns: DataFrame, p: Rules) -> DataFrame:
    """(votes, posterior) of the distinct vote patterns of (votes, n) rows."""
    fitted, post = _fitted(patterns, p)
    return fitted.select("s", F.explode("p").alias("q")).select(F.col("q.votes").alias("votes"), F.expr(post).alias("posterior"))


def learned(patterns: DataFrame, p: Rules = Rules()) -> DataFrame:
    """rule, in_good and in_bad: the share of bad votes among each rule's votes that the label model finds."""
    names = F.array(*[F.lit(name) for name, _, _ in RULES])
    zipped = _fitted(patterns, p)[0].select(F.explode(F.arrays_zip(names.alias("rule"), F.col("s.a").alias("a"), F.col("s.b").alias("b"))).alias("x"))
    return zipped.select(F.col("x.rule").alias("rule"), F.col("x.a").alias("in_good"), F.col("x.b").alias("in_bad"))


def judge(docs: DataFrame, p: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and posterior."""
    rows = settle(statistics(docs, id_col, text_col).withColumn("votes", votes()))
    patterns = rows.groupBy("votes").agg(F.count("*").alias("n"))
    # At most 3 ** len(RULES) rows of a few dozen bytes.
    verdict = F.broadcast(posteriors(patterns, p))
    failed = (F.col("n_words") < p.least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * p.repeat_percent)
    return rows.join(verdict, "votes", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("posterior") >= p.cut)).alias("kept"), "posterior",
    )
