"""SQL equivalents of the queries, for an engine with list functions and lambdas of the form ``lambda x: ...``."""

from __future__ import annotations

from linkweave.constants import ABBREVIATIONS, HONORIFICS, LEGAL, PHONETIC_LEGAL, PHONETIC_STEPS, POLICY_GRID
from linkweave.functions.phonetic import phonetic_string


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _fold(c: str) -> str:
    return f"strip_accents(replace(lower({c}), 'ß', 'ss'))"


def _tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+')"


def _norm(c: str) -> str:
    folded = _fold(c)
    return f"list_transform({_tokens(f'''replace({folded}, '&', ' and ')''')}, lambda t: coalesce(list_extract({_list(ABBREVIATIONS.values())}, nullif(list_position({_list(ABBREVIATIONS)}, t), 0)), t))"


def _without(a: str, words) -> str:
    return f"list_filter({a}, lambda t: NOT list_contains({_list(words)}, t))"


def _text(a: str, sep: str = " ") -> str:
    return f"coalesce(array_to_string({a}, '{sep}'), '')"


def _longest(a: str, k: int) -> str:
    return f"list_transform(list_sort(list_transform({a}, lambda t: {{'l': -length(t), 't': t}}))[1:{k}], lambda s: s.t)"


def _pairs(a: str, size: int, sep: str) -> str:
    x, y = f"substr({a}[i], 1, {size})", f"substr({a}[j], 1, {size})"
    return f"flatten(list_transform(range(1, len({a}) + 1), lambda i: list_transform(range(i + 1, len({a}) + 1), lambda j: least({x}, {y}) || '{sep}' || greatest({x}, {y}))))"


def _cross(a: str, b: str, cut_a: int, cut_b: int) -> str:
    return f"flatten(list_transform({a}, lambda t: list_transform({b}, lambda z: substr(t, 1, {cut_a}) || '|' || substr(z, 1, {cut_b}))))"


def _record(key: str, name: str, address: str, country: str, table: str) -> str:
    return f"SELECT 'S' || ({key} % 3 + 1) || '-' || {key} AS entity_id, {name} AS business_name, {address} AS business_address, {country} AS country, 'S' || ({key} % 3 + 1) AS source FROM {table}"


_DOCS = f"(SELECT doc_id, lang, {_tokens(_fold('text'))} AS w FROM documents)"
RECORDS = {
    "documents": _record("doc_id", _text("w[1:6]"), _text("w[7:18]"), "lang", _DOCS),
    "parts": _record("p_partkey", "p_name", "p_brand || ' ' || p_type || ' ' || p_size", "'part'", "part"),
    "customers": _record("c_custkey", "c_name", "c_mktsegment || ' ' || (c_custkey % 97) || ' ' || n_name", "CAST(n_regionkey AS VARCHAR)", "customer JOIN nation ON c_nationkey = n_nationkey"),
}


def prelude(adapter: str = "documents") -> str:
    """WITH rec, prep, keyed and posted tables of an adapter."""
    core = _without("nl", LEGAL)
    raw = "lower(business_name)"
    # This engine's word boundaries are of ASCII alone; neighbours share a separator, so each pattern runs twice.
    w = "[^\\p{L}\\p{N}_]"
    for pattern, by in ((f"(^|{w})(?:l{w}*l{w}*c|l{w}*l{w}*p|p{w}*v{w}*t)($|{w})", "\\1 \\2"), (f"()(?:https?://|www\\.)()", "\\1 \\2"), (f"()\\.(?:com|in|org|net)($|{w})", "\\1 \\2")):
        raw = f"regexp_replace(regexp_replace({raw}, '{pattern}', '{by}', 'g'), '{pattern}', '{by}', 'g')"
    kept = f"list_filter({_norm(raw)}, lambda t: NOT list_contains({_list([*LEGAL, *HONORIFICS])}, t) AND NOT regexp_matches(t, '^\\p{{Nd}}{{7,}}$'))"
    letters = "list_filter(adt, lambda t: regexp_matches(t, '^\\p{L}+$') AND length(t) >= 4)"
    kinds = [
        ("name", "[n]"),
        ("core", f"[{_text('nt')}]"),
        ("prefix", "[" + _text("list_sort(list_transform(nt, lambda t: substr(t, 1, 4)))") + "]"),
        ("addr", f"[{_text('adt')}]"),
        ("pair", _pairs("top5", 5, " ")),
        ("num", _cross("top4", "nums[1:4]", 4, 99)),
        ("local", _cross("top4", "strong[1:2]", 4, 5)),
    ]
    extra = [
        ("compact", f"[{_text('nt', '')}, {_text('plain', '')}]"),
        ("addrnum", _cross("strong[1:3]", "nums[1:3]", 6, 99)),
        ("addrpair", _pairs("strong", 6, "|")),
    ]

    def made(prefix: str, kinds: list[tuple[str, str]]) -> str:
        return " || ".join(f"list_transform(list_filter({v}, lambda v: v <> ''), lambda v: c || '|{prefix}{k}|' || v)" for k, v in kinds)

    return f"""
WITH RECURSIVE rec AS ({RECORDS[adapter]}),
l1 AS (SELECT *, {_norm('business_name')} AS nl, {_norm('business_address')} AS al, {_text(_norm('country'))} AS c, {kept} AS el FROM rec),
l2 AS (SELECT *, {_text('nl')} AS n, {_text('al')} AS a, {core} AS plain FROM l1),
prep AS (SELECT *, list_sort(list_distinct(CASE WHEN len(plain) > 0 THEN plain ELSE nl END)) AS nt, list_sort(list_distinct(al)) AS adt,
  list_sort(list_distinct(regexp_extract_all(a, '\\p{{Nd}}+'))) AS nums,
  {_text('el')} AS core, {_text('el', '')} AS compact, {_text('list_transform(el, lambda t: substr(t, 1, 1))', '')} AS acronym FROM l2),
tops AS (SELECT *, {_longest('nt', 5)} AS top5, list_filter({_longest('nt', 4)}, lambda t: length(t) >= 3) AS top4, {_longest(letters, 4)} AS strong FROM prep),
keyed AS (SELECT entity_id, source, list_distinct({made('', kinds)}) AS base, list_distinct({made('extra|', extra)}) AS extra FROM tops),
post AS (SELECT entity_id, source, unnest(base || extra) AS key FROM keyed)"""


def _candidates(cap: int, most: int) -> str:
    return f""",
blocks AS (SELECT key, count(*) AS block FROM post WHERE source <> 'S1' GROUP BY key HAVING count(*) <= {cap}),
votes AS (SELECT q.entity_id AS q, t.entity_id AS t, count(*) AS votes FROM post q JOIN blocks USING (key) JOIN post t USING (key) WHERE q.source = 'S1' AND t.source <> 'S1' GROUP BY 1, 2),
ranked AS (SELECT q, t, votes, row_number() OVER (PARTITION BY q ORDER BY votes DESC, t) AS rank FROM votes),
cand AS (SELECT q, t, votes, rank FROM ranked WHERE rank <= {most})"""


def _prep_of(adapter: str, columns: str) -> str:
    return prelude(adapter) + f" SELECT {columns} FROM prep"


TRUTH = f"""truth_words AS (SELECT doc_id, lang, md5({_text(_tokens(_fold('text')))}) AS h FROM documents),
truth_ids AS (SELECT a.doc_id AS x, b.doc_id AS y FROM (SELECT lang, h, min(doc_id) AS doc_id FROM truth_words WHERE doc_id % 3 = 0 GROUP BY 1, 2) a JOIN truth_words b ON a.lang = b.lang AND a.h = b.h WHERE b.doc_id % 3 <> 0),
truth AS (SELECT 'S' || (x % 3 + 1) || '-' || x AS q, 'S' || (y % 3 + 1) || '-' || y AS t FROM truth_ids)"""

#: Synthetic scores by arithmetic of ids: of each reference's next targets of its language, and of three quarters of the truth.
PREDICTED = f"""pred_ids AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM documents a, unnest([1, 2, 4, 5, 7, 8]) AS u(d) JOIN documents b ON b.doc_id = a.doc_id + u.d AND a.lang = b.lang WHERE a.doc_id % 3 = 0
  UNION SELECT x, y FROM truth_ids WHERE (x + y) % 4 <> 0),
pred AS (SELECT 'S' || (x % 3 + 1) || '-' || x AS q, 'S' || (y % 3 + 1) || '-' || y AS t, ((x * 37 + y * 11) % 100) / 100.0 AS p0 FROM pred_ids),
scored AS (SELECT q, t, CASE WHEN (q, t) IN (SELECT q, t FROM truth) THEN 0.5 + p0 / 2 ELSE p0 END AS p FROM pred),
ents AS (SELECT DISTINCT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS q, lang AS country FROM documents WHERE doc_id % 3 = 0)"""


def _each(pred: str, extra: str = "") -> str:
    """Scored entities of a predicate on scored pairs."""
    return f"""
  SELECT e.q, e.country, coalesce(nt, 0) AS n_truth, coalesce(np, 0) AS n_pred, coalesce(g, 0) AS good,
    CASE WHEN coalesce(nt, 0) = 0 AND coalesce(np, 0) = 0 THEN 1.0 ELSE 1.25 * coalesce(g, 0) / (0.25 * coalesce(nt, 0) + coalesce(np, 0)) END AS score
  FROM ents e LEFT JOIN (SELECT q, count(DISTINCT t) AS nt FROM truth GROUP BY q) USING (q)
  LEFT JOIN (SELECT s.q, count(DISTINCT s.t) AS np, count(DISTINCT CASE WHEN truth.t IS NOT NULL THEN s.t END) AS g FROM scored s LEFT JOIN truth ON truth.q = s.q AND truth.t = s.t WHERE {pred} GROUP BY s.q) USING (q)"""


_SUMMARY = """round(avg(score), 9) AS macro_f05,
  round(greatest(0.0, avg(score) - 1.96 * coalesce(stddev_samp(score) / sqrt(count(*)), 0.0)), 9) AS low, round(least(1.0, avg(score) + 1.96 * coalesce(stddev_samp(score) / sqrt(count(*)), 0.0)), 9) AS high,
  round(sum(good) / greatest(1, sum(n_pred)), 9) AS micro_precision, round(sum(good) / greatest(1, sum(n_truth)), 9) AS micro_recall,
  CAST(sum(good) AS BIGINT) AS tp, CAST(sum(n_pred) - sum(good) AS BIGINT) AS fp, CAST(sum(n_truth) - sum(good) AS BIGINT) AS fn, count(*) AS entities,
  count(*) FILTER (n_truth = 0) AS singletons, count(*) FILTER (n_truth = 0 AND n_pred = 0) AS correct_singletons"""

_WITH_PRED = f"WITH {TRUTH}, {PREDICTED}"


def _overlap(a: str, b: str, name: str) -> str:
    both, union = f"len(list_intersect({a}, {b}))", f"len(list_distinct({a} || {b}))"
    return f"""round({both} / greatest(1, {union}), 9) AS {name}_jaccard, round({both} / greatest(1, least(len({a}), len({b}))), 9) AS {name}_overlap,
 round({both} / greatest(1, len({a})), 9) AS {name}_left, round({both} / greatest(1, len({b})), 9) AS {name}_right"""


def _numbers(a: str, b: str) -> str:
    out = []
    for k in range(1, 6):
        x, y = (f"list_filter({s}, lambda v: length(v) >= {k})" for s in (a, b))
        both = f"len(list_intersect({x}, {y}))"
        out += [f"len({x}) - {both} AS num{k}_l", f"len({y}) - {both} AS num{k}_r", f"{both} AS num{k}_both"]
    return ", ".join(out)


_FREQ = f""",
texts AS (
  SELECT c, unnest([{{'kind': 'N', 'text': n}}, {{'kind': 'C', 'text': {_text('nt')}}}, {{'kind': 'E', 'text': core}}, {{'kind': 'A', 'text': {_text('adt')}}}]
    || list_transform(nt, lambda t: {{'kind': 'n', 'text': t}}) || list_transform(adt, lambda t: {{'kind': 'a', 'text': t}})) AS x
  FROM prep WHERE source = 'S1'),
freq AS (SELECT c, x.kind AS kind, x.text AS text, count(*) AS cnt FROM texts WHERE x.text <> '' GROUP BY 1, 2, 3),
pop AS (SELECT c, count(*) AS pop FROM prep WHERE source = 'S1' GROUP BY c)"""

#: Longest common subsequence by rows of the table: one step appends a row for the next letter of x.
def _lcs(pairs: str) -> str:
    """CTEs over (x, y) of ``pairs`` that give lcs_of(x, y, l)."""
    return f""",
uniq AS (SELECT DISTINCT x, y FROM {pairs}),
dp AS (
  SELECT x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda k: 0) AS row FROM uniq
  UNION ALL
  SELECT x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, CASE WHEN substr(x, i + 1, 1) = substr(y, j, 1) THEN row[j] + 1 ELSE greatest(row[j + 1], acc[j]) END), [0])
  FROM dp WHERE i < length(x)),
lcs_of AS (SELECT x, y, row[length(y) + 1] AS l FROM dp WHERE i = length(x))"""


def _bits(pairs: str) -> str:
    """CTEs over (x, y) of ``pairs`` that give lcs_of(x, y, l), a bit of an integer for each letter of x; for many pairs."""
    mask = "list_sum(list_transform(range(length(x)), lambda i: CASE WHEN substr(x, i + 1, 1) = c THEN CAST(1 AS HUGEINT) << CAST(i AS HUGEINT) ELSE CAST(0 AS HUGEINT) END))"
    return f""",
uniq AS (SELECT DISTINCT x, y FROM {pairs}),
tables AS (SELECT x, map_from_entries(list_transform(list_distinct(string_split(x, '')), lambda c: {{'k': c, 'v': CAST({mask} AS HUGEINT)}})) AS m, (CAST(1 AS HUGEINT) << CAST(length(x) AS HUGEINT)) - 1 AS whole FROM (SELECT DISTINCT x FROM uniq WHERE x <> '')),
lcs_of AS (
  SELECT uniq.x, y, CASE WHEN uniq.x = '' OR y = '' THEN 0 ELSE length(uniq.x) - bit_count(list_reduce(list_transform(string_split(y, ''), lambda c: coalesce(m[c], CAST(0 AS HUGEINT))), lambda acc, k: ((acc + (acc & k)) | (acc - (acc & k))) & whole, whole)) END AS l
  FROM uniq LEFT JOIN tables ON tables.x = uniq.x)"""


def _all_fuzzy(pairs: str) -> str:
    """CTEs that give fz(x, y, ratio, partial, token_sort, token_set, weighted) of (x, y) of ``pairs``."""
    split = lambda c: f"list_filter(string_split({c}, ' '), lambda v: v <> '')"
    only = lambda a, b: f"list_sort(list_distinct(list_filter({a}, lambda v: NOT list_contains({b}, v))))"
    part = lambda a, b: f"list_transform(range(1 - length({a}), length({b})), lambda i: substr({b}, greatest(i, 0) + 1, least(i + length({a}), length({b})) - greatest(i, 0)))"
    r = lambda t, a, b: f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE 2.0 * {t}.l / (length({a}) + length({b})) END"
    return f""",
fz1 AS (SELECT x, y, {split('x')} AS xt, {split('y')} AS yt FROM (SELECT DISTINCT x, y FROM {pairs})),
fz2 AS (SELECT *, {_text('list_sort(xt)')} AS xs, {_text('list_sort(yt)')} AS ys, list_sort(list_distinct(list_intersect(xt, yt))) AS b, {only('xt', 'yt')} AS lo, {only('yt', 'xt')} AS ro FROM fz1),
fz3 AS (SELECT *, {_text('b')} AS bs, {_text('b || lo')} AS ls, {_text('b || ro')} AS rs, {_text('lo')} AS lt, {_text('ro')} AS rt FROM fz2),
pin AS (SELECT x, y FROM fz3 UNION SELECT xs, ys FROM fz3 UNION SELECT lt, rt FROM fz3),
turned AS (SELECT x, y, x AS a, y AS b FROM pin WHERE x <> '' AND y <> '' AND length(x) <= length(y) UNION SELECT x, y, y, x FROM pin WHERE x <> '' AND y <> '' AND length(y) <= length(x)),
cuts AS (SELECT a, b, unnest({part('a', 'b')}) AS w FROM (SELECT DISTINCT a, b FROM turned)),
need AS (SELECT a AS x, w AS y FROM cuts UNION SELECT x, y FROM fz3 UNION SELECT xs, ys FROM fz3 UNION SELECT ls, rs FROM fz3 UNION SELECT bs, ls FROM fz3 UNION SELECT bs, rs FROM fz3){_bits('need')},
best AS (SELECT a, b, max(2.0 * l / (length(a) + length(w))) AS p FROM cuts JOIN lcs_of ON x = a AND y = w GROUP BY 1, 2),
par AS (SELECT pin.x, pin.y, coalesce(max(p), CASE WHEN pin.x = pin.y THEN 1.0 ELSE 0.0 END) AS p FROM pin LEFT JOIN turned USING (x, y) LEFT JOIN best ON best.a = turned.a AND best.b = turned.b GROUP BY pin.x, pin.y),
fz4 AS (SELECT f.*, {r('l1', 'f.x', 'f.y')} AS ratio, p1.p AS partial, {r('l2', 'f.xs', 'f.ys')} AS token_sort,
  CASE WHEN len(xt) = 0 OR len(yt) = 0 THEN 0.0 WHEN len(f.b) > 0 AND (len(lo) = 0 OR len(ro) = 0) THEN 1.0
    ELSE greatest({r('l3', 'f.ls', 'f.rs')}, CASE WHEN len(f.b) > 0 THEN greatest({r('l4', 'f.bs', 'f.ls')}, {r('l5', 'f.bs', 'f.rs')}) ELSE 0.0 END) END AS token_set,
  CASE WHEN len(f.b) > 0 THEN 1.0 ELSE greatest(p2.p, p3.p) END AS ptok
  FROM fz3 f JOIN lcs_of l1 ON l1.x = f.x AND l1.y = f.y JOIN lcs_of l2 ON l2.x = f.xs AND l2.y = f.ys JOIN lcs_of l3 ON l3.x = f.ls AND l3.y = f.rs
  JOIN lcs_of l4 ON l4.x = f.bs AND l4.y = f.ls JOIN lcs_of l5 ON l5.x = f.bs AND l5.y = f.rs
  JOIN par p1 ON p1.x = f.x AND p1.y = f.y JOIN par p2 ON p2.x = f.xs AND p2.y = f.ys JOIN par p3 ON p3.x = f.lt AND p3.y = f.rt),
fz5 AS (SELECT *, greatest(length(x), length(y)) / greatest(1, least(length(x), length(y))) AS longer FROM fz4),
fz AS (SELECT x, y, ratio, partial, token_sort, token_set, CASE WHEN x = '' OR y = '' THEN 0.0 WHEN longer < 1.5 THEN greatest(ratio, 0.95 * greatest(token_sort, token_set))
  ELSE greatest(ratio, CASE WHEN longer <= 8 THEN 0.9 ELSE 0.6 END * partial, 0.95 * CASE WHEN longer <= 8 THEN 0.9 ELSE 0.6 END * ptok) END AS weighted FROM fz5)"""


def _base_features(adapter: str, cap: int, most: int) -> str:
    """All base features of an adapter's candidates."""
    fields = {"name": ("ln", "rn"), "core_name": ("lc", "rc"), "address": ("la", "ra")}
    columns, joins = [], []
    for k, (x, y) in fields.items():
        columns += [f"round({k}.{s}, 6) AS f_{k}_{s}" for s in ("ratio", "partial", "token_sort", "token_set", "weighted")]
        columns += [f"CASE WHEN {x} <> '' AND {x} = {y} THEN 1.0 ELSE 0.0 END AS f_{k}_exact", f"round(least(length({x}), length({y})) / greatest(1, length({x}), length({y})), 6) AS f_{k}_length"]
        joins.append(f"JOIN fz {k} ON {k}.x = {x} AND {k}.y = {y}")
    for k, c in (("name_tokens", "nt"), ("address_tokens", "at"), ("numbers", "nums")):
        columns.append(_overlap(f"l{c}", f"r{c}", f"f_{k}").replace(", 9)", ", 6)"))
    columns += [f"CAST(len({s}{c}) AS DOUBLE) AS f_{c}_{s}" for c in ("nt", "at", "nums") for s in "lr"]
    both = "len(list_intersect(lnums, rnums))"
    columns += [f"CAST(len(lnums) - {both} AS DOUBLE) AS f_nums_only_l", f"CAST(len(rnums) - {both} AS DOUBLE) AS f_nums_only_r", "CASE WHEN lco = rco THEN 1.0 ELSE 0.0 END AS f_same_country"]
    columns += [f"CASE WHEN {s}{c} = '' THEN 1.0 ELSE 0.0 END AS f_missing_{s}_{c}" for c in ("n", "a") for s in "lr"]
    columns += [f"round(coalesce({s}.{m}, 0.0), 6) AS f_align_{s}_{m}" for s in ("lr", "rl") for m in ("least", "mean")]
    align = lambda a, b: f"""(SELECT q, t, min(s) AS least, avg(s) AS mean FROM (
    SELECT q, t, u.w, max(coalesce(tr.ratio, 0.0)) AS s FROM duo, unnest({a}) AS u(w) LEFT JOIN tr ON tr.q2 = q AND tr.t2 = t AND tr.side = '{a}' AND tr.x = u.w GROUP BY 1, 2, 3) GROUP BY 1, 2)"""  # noqa: E731
    return (
        prelude(adapter)
        + _candidates(cap, most)
        + f""",
duo AS (SELECT q, t, x.n AS ln, y.n AS rn, {_text('x.nt')} AS lc, {_text('y.nt')} AS rc, x.a AS la, y.a AS ra, x.nt AS lnt, y.nt AS rnt, x.adt AS lat, y.adt AS rat, x.nums AS lnums, y.nums AS rnums, x.c AS lco, y.c AS rco
  FROM cand JOIN prep x ON x.entity_id = q JOIN prep y ON y.entity_id = t),
tok AS (SELECT q, t, u.w AS x, v.w AS y FROM duo, unnest(lnt) AS u(w), unnest(rnt) AS v(w)),
strings AS (SELECT ln AS x, rn AS y FROM duo UNION SELECT lc, rc FROM duo UNION SELECT la, ra FROM duo UNION SELECT x, y FROM tok){_all_fuzzy('strings')},
tr AS (SELECT tok.q AS q2, tok.t AS t2, 'lnt' AS side, tok.x AS x, max(ratio) AS ratio FROM tok JOIN fz USING (x, y) GROUP BY 1, 2, 3, 4 UNION ALL SELECT tok.q, tok.t, 'rnt', tok.y, max(ratio) FROM tok JOIN fz USING (x, y) GROUP BY 1, 2, 3, 4)
SELECT duo.q, duo.t, {', '.join(columns)} FROM duo {' '.join(joins)} LEFT JOIN {align('lnt', 'rnt')} lr ON lr.q = duo.q AND lr.t = duo.t LEFT JOIN {align('rnt', 'lnt')} rl ON rl.q = duo.q AND rl.t = duo.t"""
    )


def _similarity(adapter: str, cap: int, most: int) -> str:
    combined = "0.45 * n.ratio + 0.45 * a.token_set + 0.10 * len(list_intersect(x.nums, y.nums)) / greatest(1, len(list_distinct(x.nums || y.nums)))"
    return (
        prelude(adapter)
        + _candidates(cap, most)
        + f""", strings AS (SELECT x.compact AS x, y.compact AS y FROM cand JOIN prep x ON x.entity_id = q JOIN prep y ON y.entity_id = t UNION SELECT x.a, y.a FROM cand JOIN prep x ON x.entity_id = q JOIN prep y ON y.entity_id = t){_all_fuzzy('strings')}
SELECT q, t, round(n.ratio, 9) AS name_sim, round(a.token_set, 9) AS addr_sim, round({combined}, 9) AS combined
FROM cand JOIN prep x ON x.entity_id = cand.q JOIN prep y ON y.entity_id = cand.t JOIN fz n ON n.x = x.compact AND n.y = y.compact JOIN fz a ON a.x = x.a AND a.y = y.a"""
    )


def _sweep(thresholds: list[float]) -> str:
    parts = [f"SELECT CAST({t!r} AS DOUBLE) AS tau, round(avg(score), 9) AS macro_f05 FROM ({_each(f's.p >= {t!r}')})" for t in thresholds]
    return _WITH_PRED + " " + " UNION ALL ".join(parts)


def _policies() -> str:
    cells = [(a, b) for a in POLICY_GRID for b in POLICY_GRID]
    rows = ", ".join(f"({a!r}, {b!r})" for a, b in cells)
    return (
        _WITH_PRED
        + f""", grid(s2, s3) AS (VALUES {rows}),
hits AS (SELECT g.s2, g.s3, s.q, count(*) AS np, count(truth.t) AS gd FROM grid g JOIN scored s ON s.p >= CASE WHEN starts_with(s.t, 'S2-') THEN g.s2 ELSE g.s3 END LEFT JOIN truth ON truth.q = s.q AND truth.t = s.t GROUP BY 1, 2, 3),
tn AS (SELECT q, count(DISTINCT t) AS nt FROM truth GROUP BY q),
f AS (SELECT g.s2, g.s3, CASE WHEN coalesce(nt, 0) = 0 AND coalesce(np, 0) = 0 THEN 1.0 ELSE 1.25 * coalesce(gd, 0) / (0.25 * coalesce(nt, 0) + coalesce(np, 0)) END AS score
  FROM grid g CROSS JOIN ents e LEFT JOIN tn USING (q) LEFT JOIN hits h ON h.q = e.q AND h.s2 = g.s2 AND h.s3 = g.s3)
SELECT CAST(s2 AS DOUBLE) AS s2, CAST(s3 AS DOUBLE) AS s3, round(avg(score), 9) AS macro_f05 FROM f GROUP BY 1, 2"""
    )


def _phonetic(t: str) -> str:
    out = t
    for v in "eiy":
        out = f"replace({out}, 'c{v}', 's{v}')"
    for a, b in PHONETIC_STEPS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace({out}, '[aeiouy]', '', 'g')"


def _squeeze(t: str) -> str:
    return f"coalesce(array_to_string(list_filter(string_split({t}, ''), lambda x, i: i = 1 OR x <> string_split({t}, '')[i - 1]), ''), '')"


_P_DROP = _list(["", *sorted({phonetic_string(w) for w in PHONETIC_LEGAL})])
_FORMS = f"""
WITH rec AS ({RECORDS['documents']}),
f1 AS (SELECT *, list_filter({_tokens(_fold('business_name'))}, lambda t: NOT list_contains({_list(LEGAL)}, t)) AS rl, {_text(_tokens(_fold('business_address')))} AS ra FROM rec),
f2 AS (SELECT *, list_filter(list_transform(list_transform(rl, lambda t: {_phonetic('t')}), lambda t: {_squeeze('t')}), lambda t: NOT list_contains({_P_DROP}, t)) AS pt FROM f1),
forms AS (SELECT *, {_text('rl')} AS rn, {_text('pt')} AS pn, {_text('pt', '')} AS pc FROM f2)"""

def _phonetic_candidates(cap: int, most: int) -> str:
    """Candidates by the phonetic keys alone."""
    kinds = [
        ("pn", "[pc]"), ("ps", "[" + _text("list_sort(pt)", "") + "]"), ("pt", "list_filter(toks, lambda t: length(t) >= 3)"), ("pp", _pairs("toks", 4, "|")),
        ("pf", "[CASE WHEN length(pc) >= 8 THEN substr(pc, 1, 8) ELSE '' END]"), ("pl", "[CASE WHEN length(pc) >= 8 THEN right(pc, 8) ELSE '' END]"), ("ap", _pairs("far", 64, "|")),
    ]
    made = " || ".join(f"list_transform(list_filter({v}, lambda v: v <> ''), lambda v: c || '|v4|{k}|' || v)" for k, v in kinds)
    far = "list_distinct(list_filter(string_split(ra, ' '), lambda t: regexp_matches(t, '^\\p{L}+$') AND length(t) >= 5))"
    return f"""{_FORMS},
f3 AS (SELECT *, {_text(_norm('country'))} AS c, {_longest('list_distinct(pt)', 5)} AS toks, {_longest(far, 4)} AS far FROM forms),
post AS (SELECT entity_id, source, unnest(list_distinct({made})) AS key FROM f3){_candidates(cap, most)} SELECT q, t, votes, rank FROM cand"""


_SHORT_PAIRS = f"""{prelude('parts')},
near AS (SELECT n, CAST(split_part(entity_id, '-', 2) AS BIGINT) AS k FROM prep),
named AS (SELECT DISTINCT a.n AS x, b.n AS y FROM near a, unnest(range(1, 9)) AS u(d) JOIN near b ON b.k = a.k + u.d)"""

_SORTED = "array_to_string(list_sort(string_split({c}, ' ')), ' ')"


def _cheap() -> str:
    """Token-set scores of cores and addresses of the candidates, and the filter on them."""
    split = lambda c: f"list_filter(string_split({c}, ' '), lambda v: v <> '')"
    x, y = split("x"), split("y")
    score = """CASE WHEN strs.x = '' OR strs.y = '' THEN 0.0 WHEN len(b) > 0 AND (len(lo) = 0 OR len(ro) = 0) THEN 1.0
      ELSE greatest(2.0 * p.l / (length(ls) + length(rs)), CASE WHEN len(b) > 0 THEN greatest(2.0 * q.l / (length(bs) + length(ls)), 2.0 * r.l / (length(bs) + length(rs))) ELSE 0.0 END) END"""
    return f""",
duo AS (SELECT q, t, x.a AS xa, y.a AS ya, {_text('x.nt')} AS xn, {_text('y.nt')} AS yn FROM cand JOIN prep x ON x.entity_id = q JOIN prep y ON y.entity_id = t),
named AS (SELECT xa AS x, ya AS y FROM duo UNION SELECT xn, yn FROM duo),
sets AS (SELECT x, y, list_sort(list_distinct(list_intersect({x}, {y}))) AS b,
  list_sort(list_distinct(list_filter({x}, lambda v: NOT list_contains({y}, v)))) AS lo, list_sort(list_distinct(list_filter({y}, lambda v: NOT list_contains({x}, v)))) AS ro FROM named),
strs AS (SELECT *, {_text('b')} AS bs, {_text('b || lo')} AS ls, {_text('b || ro')} AS rs FROM sets),
todo AS (SELECT ls AS x, rs AS y FROM strs UNION SELECT bs, ls FROM strs UNION SELECT bs, rs FROM strs){_lcs('todo')},
sc AS (SELECT strs.x, strs.y, {score} AS s FROM strs JOIN lcs_of p ON p.x = ls AND p.y = rs JOIN lcs_of q ON q.x = bs AND q.y = ls JOIN lcs_of r ON r.x = bs AND r.y = rs)
SELECT q, t, round(n.s, 6) AS ns, round(a.s, 6) AS ads, n.s >= 0.9 - 1e-7 OR a.s >= 0.85 - 1e-7 OR (n.s >= 0.35 - 1e-7 AND a.s >= 0.5 - 1e-7) OR ((xa = '' OR ya = '') AND n.s >= 0.5 - 1e-7) AS kept
FROM duo JOIN sc n ON n.x = xn AND n.y = yn JOIN sc a ON a.x = xa AND a.y = ya"""


THRESHOLDS = [i / 40 for i in range(4, 39)]
GATED = "((CAST(split_part(q, '-', 2) AS BIGINT)) % 2 = 0)"



def _format_findings() -> str:
    """What the faults made by id amount to."""
    rules = [
        ("error", "malformed_row", "SELECT q AS x FROM f WHERE k = 2"),
        ("error", "reference_repeated", "SELECT q AS x FROM f WHERE k = 1"),
        ("error", "list_repeats", "SELECT q AS x FROM f WHERE k = 5"),
        ("error", "self_match", "SELECT q AS x FROM f WHERE k = 3"),
        ("error", "target_prefix", "SELECT DISTINCT 'X9-1' AS x FROM f WHERE k = 4"),
        ("error", "reference_missing", "SELECT q AS x FROM f WHERE k IN (0, 2)"),
        ("error", "reference_unknown", "SELECT 'S1-999999999' AS x"),
        ("error", "target_unknown", "SELECT DISTINCT 'S2-999999999' AS x FROM f WHERE k = 6 UNION SELECT DISTINCT 'S2-1' FROM f WHERE k = 5 AND 'S2-1' NOT IN (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id FROM documents)"),
        ("warning", "match_no_candidate", "SELECT q AS x FROM f WHERE k IN (3, 4, 6) OR (k = 5 AND q NOT IN (SELECT q FROM scored WHERE t = 'S2-1'))"),
    ]
    parts = [f"SELECT '{s}' AS severity, '{r}' AS rule, (SELECT count(*) FROM ({sql})) AS n, coalesce((SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT x FROM ({sql}) ORDER BY x LIMIT 5)), '') AS examples" for s, r, sql in rules]
    return _WITH_PRED + ", f AS (SELECT q, CAST(split_part(q, '-', 2) AS BIGINT) // 3 % 10 AS k FROM ents) " + " UNION ALL ".join(parts)


SQL: dict[str, str] = {
    "norm_text": _prep_of("documents", "entity_id, n, a, c"),
    "norm_text_parts": _prep_of("parts", "entity_id, n, a, c"),
    "prep_tokens": _prep_of("customers", f"entity_id, {_text('nt')} AS nt, {_text('adt')} AS \"at\", {_text('nums')} AS nums"),
    "extended_forms": prelude("documents") + f" SELECT entity_id, core, compact, acronym, {_text('list_filter(adt, lambda t: NOT regexp_matches(t, {0}))'.format(chr(39) + '^[0-9]+$' + chr(39)))} AS words, regexp_matches(n, '[^\\x00-\\x7F]') AS nonascii FROM prep",
    "phonetic_fold": _FORMS + " SELECT entity_id, rn, pn, pc, ra FROM forms",
    "blocking_keys": prelude("documents") + " SELECT entity_id, unnest(base) AS key FROM keyed",
    "extra_keys": prelude("customers") + " SELECT entity_id, unnest(extra) AS key FROM keyed",
    "block_sizes": prelude("parts") + " SELECT key, count(*) AS block, count(*) <= 20 AS used FROM post WHERE source <> 'S1' GROUP BY key",
    "candidates_topk": prelude("documents") + _candidates(100, 240) + " SELECT * FROM cand",
    "candidates_capped_ties": prelude("parts") + _candidates(20, 10) + " SELECT * FROM cand",
    "overlap_features": prelude("documents") + _candidates(100, 240) + f" SELECT q, t, {_overlap('x.nt', 'y.nt', 'name')}, {_overlap('x.adt', 'y.adt', 'addr')}, {_overlap('x.nums', 'y.nums', 'nums')} FROM cand JOIN prep x ON x.entity_id = q JOIN prep y ON y.entity_id = t",
    "number_features": prelude("customers") + _candidates(100, 20) + f" SELECT q, t, {_numbers('x.nums', 'y.nums')} FROM cand JOIN prep x ON x.entity_id = q JOIN prep y ON y.entity_id = t",
    "freq_tables": prelude("documents") + _FREQ + " SELECT c, kind, text, cnt FROM freq",
    "idf_weights": prelude("documents") + _FREQ + " SELECT c, text, round(ln(1 + pop / (1 + cnt)), 9) AS weight FROM freq JOIN pop USING (c) WHERE kind = 'n'",
    "rarity_features": prelude("documents") + _FREQ + " SELECT entity_id, coalesce(f.cnt, 0) AS name_count, coalesce(g.cnt, 0) AS core_count, round(ln(1 + coalesce(f.cnt, 0)), 9) AS name_log, coalesce(g.cnt, 0) = 1 AS core_once FROM prep p LEFT JOIN freq f ON f.c = p.c AND f.kind = 'N' AND f.text = p.n LEFT JOIN freq g ON g.c = p.c AND g.kind = 'C' AND g.text = array_to_string(p.nt, ' ')",
    "weighted_overlap": prelude("documents") + _candidates(100, 240) + _FREQ + """,
side AS (SELECT p.entity_id, u.t AS tok, ln(1 + coalesce(pop, 1) / (1 + coalesce(cnt, 0))) AS w FROM prep p, unnest(p.nt) AS u(t) LEFT JOIN freq f ON f.c = p.c AND f.kind = 'n' AND f.text = u.t LEFT JOIN pop ON pop.c = p.c),
lr AS (SELECT q, t, tok, w, 'l' AS s FROM cand JOIN side ON entity_id = q UNION ALL SELECT q, t, tok, w, 'r' FROM cand JOIN side ON entity_id = t),
tok AS (SELECT q, t, tok, max(w) AS w, count(*) AS k, min(s) AS s FROM lr GROUP BY 1, 2, 3),
agg AS (SELECT q, t, coalesce(sum(w) FILTER (k = 2), 0) AS si, coalesce(sum(w) FILTER (k = 2 OR s = 'l'), 0) AS sl, coalesce(sum(w) FILTER (k = 2 OR s = 'r'), 0) AS sr,
  coalesce(max(w) FILTER (k = 1 AND s = 'l'), 0) AS ml, coalesce(max(w) FILTER (k = 1 AND s = 'r'), 0) AS mr, coalesce(max(w) FILTER (k = 2), 0) AS mc FROM tok GROUP BY 1, 2)
SELECT q, t, round(si / greatest(1e-6, sl + sr - si), 6) AS jaccard, round(si / greatest(1e-6, sl), 6) AS cover_l, round(si / greatest(1e-6, sr), 6) AS cover_r, round(ml, 6) AS only_l, round(mr, 6) AS only_r, round(mc, 6) AS common FROM agg""",
    "indel_ratio": _SHORT_PAIRS + _lcs("named") + " SELECT x, y, round(CASE WHEN length(x) + length(y) = 0 THEN 1.0 ELSE 2.0 * l / (length(x) + length(y)) END, 9) AS ratio FROM named JOIN lcs_of USING (x, y)",
    "token_sort_ratio": _SHORT_PAIRS + f", sorts AS (SELECT x AS x0, y AS y0, {_SORTED.format(c='x')} AS x, {_SORTED.format(c='y')} AS y FROM named)" + _lcs("sorts") + " SELECT x0 AS x, y0 AS y, round(2.0 * l / (length(sorts.x) + length(sorts.y)), 9) AS ratio FROM sorts JOIN lcs_of ON lcs_of.x = sorts.x AND lcs_of.y = sorts.y",
    "token_set_ratio": _SHORT_PAIRS + """,
sets AS (SELECT x AS x0, y AS y0, list_sort(list_distinct(list_intersect(string_split(x, ' '), string_split(y, ' ')))) AS b,
  list_sort(list_distinct(list_filter(string_split(x, ' '), lambda t: NOT list_contains(string_split(y, ' '), t)))) AS l, list_sort(list_distinct(list_filter(string_split(y, ' '), lambda t: NOT list_contains(string_split(x, ' '), t)))) AS r FROM named),
strs AS (SELECT *, array_to_string(b, ' ') AS bs, array_to_string(b || l, ' ') AS ls, array_to_string(b || r, ' ') AS rs FROM sets),
todo AS (SELECT ls AS x, rs AS y FROM strs UNION SELECT bs, ls FROM strs UNION SELECT bs, rs FROM strs)""" + _lcs("todo") + """
SELECT x0 AS x, y0 AS y, round(CASE WHEN len(b) > 0 AND (len(strs.l) = 0 OR len(strs.r) = 0) THEN 1.0 ELSE greatest(2.0 * p.l / (length(ls) + length(rs)), CASE WHEN len(b) > 0 THEN greatest(2.0 * q.l / (length(bs) + length(ls)), 2.0 * s.l / (length(bs) + length(rs))) ELSE 0 END) END, 9) AS ratio
FROM strs JOIN lcs_of p ON p.x = ls AND p.y = rs JOIN lcs_of q ON q.x = bs AND q.y = ls JOIN lcs_of s ON s.x = bs AND s.y = rs""",
    "cheap_filter": prelude("documents") + _candidates(100, 240) + _cheap(),
    "truth_lists": f"WITH {TRUTH} SELECT q, string_agg(DISTINCT t, ',' ORDER BY t) AS matches FROM truth GROUP BY q",
    "label_join": prelude("documents") + _candidates(100, 240) + f", {TRUTH} SELECT q, t, (q, t) IN (SELECT q, t FROM truth) AS label FROM cand",
    "score_entities": _WITH_PRED + " SELECT q, n_truth, n_pred, good, round(score, 9) AS score FROM (" + _each("s.p >= 0.65") + ")",
    "score_macro_f05": _WITH_PRED + f" SELECT {_SUMMARY} FROM (" + _each("s.p >= 0.65") + ")",
    "score_by_country": _WITH_PRED + f" SELECT country, {_SUMMARY} FROM (" + _each("s.p >= 0.65") + ") GROUP BY country",
    "blocking_ceiling": _WITH_PRED + f" SELECT {_SUMMARY} FROM (" + _each("truth.t IS NOT NULL") + ")",
    "candidate_recall": _WITH_PRED + " SELECT round(count(*) FILTER ((q, t) IN (SELECT q, t FROM pred)) / greatest(1, count(*)), 9) AS recall, count(*) AS links FROM (SELECT DISTINCT q, t FROM truth)",
    "paired_ci": _WITH_PRED + ", a AS (" + _each("s.p >= 0.5") + "), b AS (" + _each("s.p >= 0.8") + "), d AS (SELECT b.score - a.score AS d FROM a JOIN b USING (q)) SELECT round(avg(d), 9) AS mean, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 9) AS low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)), 9) AS high, count(*) AS entities FROM d",
    "threshold_sweep": _sweep(THRESHOLDS),
    "best_threshold": f"SELECT * FROM ({_sweep(THRESHOLDS)}) ORDER BY macro_f05 DESC, tau DESC LIMIT 1",
    "policy_sweep": _policies(),
    "best_policy": f"SELECT * FROM ({_policies()}) ORDER BY macro_f05 DESC, s2, s3 LIMIT 1",
    "source_thresholds": _WITH_PRED + " SELECT q, t, p FROM scored WHERE p >= CASE WHEN starts_with(t, 'S2-') THEN 0.65 ELSE 0.75 END",
    "gate_select": _WITH_PRED + """, m AS (SELECT q, t, p FROM scored WHERE p >= 0.65), nat AS (SELECT t FROM (SELECT DISTINCT t FROM scored) WHERE CAST(split_part(t, '-', 2) AS BIGINT) % 5 = 0)
SELECT e.q, coalesce(s, false) AS suspicious, coalesce(r, false) AS recoverable, coalesce(s, false) OR coalesce(r, false) AS gated FROM ents e
LEFT JOIN (SELECT DISTINCT q, true AS s FROM m WHERE t IN (SELECT t FROM nat) AND p < 0.7) USING (q)
LEFT JOIN (SELECT DISTINCT q, true AS r FROM scored WHERE t IN (SELECT t FROM nat) AND p >= 0.6 AND (q, t) NOT IN (SELECT q, t FROM m)) USING (q)""",
    "empty_gate": _WITH_PRED + f" SELECT q FROM ents WHERE q NOT IN (SELECT q FROM scored WHERE p >= 0.65) AND NOT {GATED}",
    "override_merge": _WITH_PRED + f" SELECT q, t FROM scored WHERE CASE WHEN {GATED} THEN p >= 0.5 ELSE p >= 0.8 END",
    "result_lists": _WITH_PRED + " SELECT e.q, coalesce(c, '') AS candidates, coalesce(m, '') AS matches FROM ents e LEFT JOIN (SELECT q, string_agg(DISTINCT t, ',' ORDER BY t) AS c, string_agg(DISTINCT t, ',' ORDER BY t) FILTER (p >= 0.65) AS m FROM scored GROUP BY q) USING (q)",
    "output_stats": _WITH_PRED + " SELECT (SELECT count(*) FROM ents) AS entities, count(*) AS candidates, count(*) FILTER (p >= 0.65) AS matches, (SELECT count(*) FROM ents) - count(DISTINCT q) FILTER (p >= 0.65) AS singletons FROM scored",
    "inventory": prelude("documents") + " SELECT source, count(*) AS n_rows, count(*) FILTER (trim(business_name) = '') AS empty_business_name, count(*) FILTER (trim(business_address) = '') AS empty_business_address, count(*) FILTER (trim(country) = '') AS empty_country, count(DISTINCT country) AS countries FROM rec GROUP BY source",
    "truth_inventory": _WITH_PRED + " SELECT count(*) AS n_refs, count(*) FILTER (nt IS NULL) AS singletons, round(count(*) FILTER (nt IS NULL) / greatest(1, count(*)), 9) AS empty_share, CAST(coalesce(sum(nt), 0) AS BIGINT) AS links FROM ents LEFT JOIN (SELECT q, count(DISTINCT t) AS nt FROM truth GROUP BY q) USING (q)",
    "validate_rules": _WITH_PRED + """, refs AS (SELECT q FROM ents), res AS (SELECT q, t, p FROM scored)
SELECT * FROM (VALUES ('reference_repeated', 0), ('reference_unknown', 0), ('list_repeats', 0), ('match_no_candidate', 0), ('target_prefix', 0), ('self_match', 0), ('target_spaces', 0), ('target_form', 0), ('target_unknown', 0)) v(rule, n)
UNION ALL SELECT 'reference_missing', count(*) FROM refs WHERE CAST(split_part(q, '-', 2) AS BIGINT) % 7 = 0""",
    "reduction_ratio": prelude("documents") + _candidates(100, 240) + " SELECT (SELECT count(*) FROM cand) AS candidates, round(1 - (SELECT count(*) FROM cand) / (count(*) FILTER (source = 'S1') * count(*) FILTER (source <> 'S1')), 9) AS reduction FROM rec",
    "error_analysis": prelude("documents") + _candidates(100, 240) + f", {TRUTH}, pairs AS (SELECT cand.q, cand.t, (cand.q, cand.t) IN (SELECT q, t FROM truth) AS label, votes >= 6 AS accepted, y.a = '' AS missing, {_overlap('x.nt', 'y.nt', 'name')}, {_overlap('x.adt', 'y.adt', 'addr')}, len(x.nums) - len(list_intersect(x.nums, y.nums)) AS ol, len(y.nums) - len(list_intersect(x.nums, y.nums)) AS olr FROM cand JOIN prep x ON x.entity_id = q JOIN prep y ON y.entity_id = t) SELECT CASE WHEN accepted THEN 'fp' ELSE 'fn' END AS kind, count(*) AS n, count(*) FILTER (missing) AS missing_address, count(*) FILTER (name_jaccard >= 0.9) AS name_high, count(*) FILTER (addr_jaccard >= 0.9) AS addr_high, count(*) FILTER (ol > 0 AND olr > 0) AS numbers_disagree, count(*) FILTER (name_jaccard < 0.5) AS name_low FROM pairs WHERE accepted <> label GROUP BY 1",
    "sample_bottom_k": f"WITH rec AS ({RECORDS['documents']}) SELECT entity_id, country FROM rec WHERE source = 'S1' ORDER BY md5(entity_id || '|20260926'), entity_id LIMIT 100",
    "stratified_split": f"WITH rec AS ({RECORDS['documents']}), r AS (SELECT entity_id, country, row_number() OVER (PARTITION BY country ORDER BY md5(entity_id || '|20260927'), entity_id) - 1 AS k, count(*) OVER (PARTITION BY country) AS n FROM rec WHERE source = 'S1') SELECT entity_id, country, CASE WHEN k * 5 < n * 3 THEN 'train' WHEN k * 5 < n * 4 THEN 'tune' ELSE 'hold' END AS split FROM r",
    "union_topk_rankings": prelude("documents") + _candidates(100, 240) + f", s AS (SELECT q, t, {_overlap('x.nt', 'y.nt', 'name')}, {_overlap('x.adt', 'y.adt', 'addr')} FROM cand JOIN prep x ON x.entity_id = q JOIN prep y ON y.entity_id = t), k AS (SELECT q, t, name_jaccard AS name, addr_jaccard AS addr, row_number() OVER (PARTITION BY q ORDER BY name_jaccard DESC, t) AS r1, row_number() OVER (PARTITION BY q ORDER BY addr_jaccard DESC, t) AS r2 FROM s) SELECT q, t, name, addr FROM k WHERE r1 <= 3 OR r2 <= 3",
    "neighbors_top8": prelude("documents") + """,
nb AS (SELECT key FROM post WHERE source = 'S1' GROUP BY key HAVING count(*) <= 500),
nv AS (SELECT a.entity_id AS q, b.entity_id AS t, count(*) AS votes FROM post a JOIN nb USING (key) JOIN post b USING (key) WHERE a.source = 'S1' AND b.source = 'S1' GROUP BY 1, 2),
n1 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY votes DESC, t) AS r FROM nv), """ + f"""
n2 AS (SELECT q, t, votes, {_overlap('x.nt', 'y.nt', 'name')} FROM n1 JOIN prep x ON x.entity_id = q JOIN prep y ON y.entity_id = t WHERE r <= 120 AND q <> t),
n3 AS (SELECT q, t, votes, name_jaccard AS sim, row_number() OVER (PARTITION BY q ORDER BY name_jaccard DESC, votes DESC, t) AS rank FROM n2) SELECT q, t, votes, sim, rank FROM n3 WHERE rank <= 8""",
    "seed_expansion": prelude("documents") + _candidates(50, 20) + f""",
sd AS (SELECT q, t, {_overlap('x.nt', 'y.nt', 'name')}, {_text('y.nt')} || '#' || {_text('y.adt')} AS sig, {_text('x.nt')} || '#' || {_text('x.adt')} AS own FROM cand JOIN prep x ON x.entity_id = q JOIN prep y ON y.entity_id = t),
s1 AS (SELECT *, row_number() OVER (PARTITION BY q, sig ORDER BY name_jaccard DESC, t DESC) AS r FROM sd WHERE name_jaccard >= 0.5 AND sig <> own),
s2 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY name_jaccard DESC, t DESC) AS k FROM s1 WHERE r = 1),
hop AS (SELECT s2.q, s2.t AS s, p2.entity_id AS t, count(*) AS votes FROM s2 JOIN post p1 ON p1.entity_id = s2.t JOIN blocks ON blocks.key = p1.key JOIN post p2 ON p2.key = p1.key AND p2.source <> 'S1' WHERE s2.k <= 3 GROUP BY 1, 2, 3),
hr AS (SELECT *, row_number() OVER (PARTITION BY q, s ORDER BY votes DESC, t) AS r FROM hop)
SELECT q, t FROM cand UNION SELECT q, t FROM hr WHERE r <= 20""",
    "partial_ratio": _SHORT_PAIRS + _all_fuzzy("named") + " SELECT x, y, round(partial, 9) AS ratio FROM fz",
    "weighted_ratio": _SHORT_PAIRS + _all_fuzzy("named") + " SELECT x, y, round(weighted, 9) AS ratio FROM fz",
    "pair_similarity": _similarity("customers", 100, 3),
    "feature_vector_50_customers": _base_features("customers", 100, 3),
    "phonetic_candidates": _phonetic_candidates(500, 200),
    "ordered_numbers": f"WITH rec AS ({RECORDS['customers']}), " + ", ".join(f"{n} AS (SELECT entity_id, {_text(f'regexp_extract_all({_text(_tokens(_fold(c)))}, {chr(39)}[0-9]+[a-z]?{chr(39)})')} AS {n} FROM rec)" for n, c in (("name", "business_name"), ("address", "business_address"))) + " SELECT entity_id, name.name AS name, address.address AS address FROM name JOIN address USING (entity_id)",
    "error_examples": prelude("documents") + _candidates(100, 240) + f", {TRUTH}, errs AS (SELECT CASE WHEN votes >= 6 THEN 'fp' ELSE 'fn' END AS kind, q, t FROM (SELECT q, t, votes, (q, t) IN (SELECT q, t FROM truth) AS label FROM cand) WHERE (votes >= 6) <> label) SELECT kind, q, t, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY q, t) AS rank FROM errs) WHERE rank <= 12",
    "same_holdout": _WITH_PRED + ", o AS (" + _each("s.p >= 0.8") + "), n AS (" + _each("s.p >= 0.5") + f"), h AS (SELECT * FROM o WHERE NOT {GATED} UNION ALL SELECT * FROM n WHERE {GATED}), k AS (SELECT 'old' AS kind, * FROM o UNION ALL SELECT 'new', * FROM n UNION ALL SELECT 'hybrid', * FROM h)"
    + " SELECT kind, round(avg(k.score), 9) AS macro_f05, count(*) AS entities, round(avg(k.score - o.score), 9) AS gain, round(avg(k.score - o.score) - 1.96 * stddev_samp(k.score - o.score) / sqrt(count(*)), 9) AS gain_low, round(avg(k.score - o.score) + 1.96 * stddev_samp(k.score - o.score) / sqrt(count(*)), 9) AS gain_high FROM k JOIN o USING (q) GROUP BY kind",
    "correction_stats": _WITH_PRED + f""", m AS (SELECT q, t, p >= 0.8 AS o, CASE WHEN {GATED} THEN p >= 0.5 ELSE p >= 0.8 END AS m FROM scored),
e AS (SELECT ents.q, {GATED.replace('q,', 'ents.q,')} AS g, coalesce(count(*) FILTER (o), 0) AS no, coalesce(count(*) FILTER (m), 0) AS nm, coalesce(count(*) FILTER (o AND NOT m), 0) AS gone, coalesce(count(*) FILTER (m AND NOT o), 0) AS came FROM ents LEFT JOIN m ON m.q = ents.q GROUP BY 1, 2)
SELECT count(*) AS entities, count(*) FILTER (g) AS reprocessed, count(*) FILTER (gone + came > 0) AS corrected, CAST(sum(gone) AS BIGINT) AS removed, CAST(sum(came) AS BIGINT) AS added, count(*) FILTER (no = 0 AND nm > 0) AS new_nonempty, count(*) FILTER (no > 0 AND nm = 0) AS new_empty, CAST(sum(nm) AS BIGINT) AS matches FROM e""",
    "format_findings": _format_findings(),
}
