"""The queries' meaning in SQL for DuckDB."""

from __future__ import annotations

import math
from itertools import accumulate

TOP27 = math.log2(27)
BARE = "strip_accents(lower(nfc_normalize({t})))"


def norm(kind: str = "en27", t: str = "text") -> str:
    bare = BARE.format(t=t)
    return {
        "en27": f"regexp_replace({bare}, '[^a-z ]', ' ', 'g')",
        "en26": f"regexp_replace({bare}, '[^a-z]', '', 'g')",
        "ro32": f"regexp_replace(lower(nfc_normalize({t})), '[^a-zăâîșț ]', ' ', 'g')",
        "punct": f"regexp_replace({bare}, '[^a-z .,;:!?\"''()\\[\\]{{}}\\-]', ' ', 'g')",
    }[kind]


DOCS = f"docs AS (SELECT doc_id, lang, source, {norm()} AS t FROM documents)"
CUT = "CAST(floor(length(t) * CAST(0.8 AS DOUBLE)) AS BIGINT)"
SPLIT = f"{DOCS}, split AS (SELECT doc_id, lang, substring(t, 1, {CUT}) AS train, substring(t, {CUT} + 1) AS test FROM docs)"


def chars(table: str, column: str, by: str = "") -> str:
    """Counts of the characters of a column."""
    lead = f"{by}, " if by else ""
    return f"SELECT {lead}ch, count(*) AS cnt FROM (SELECT {lead}unnest(string_split({column}, '')) AS ch FROM {table} WHERE {column} <> '') GROUP BY {lead}ch"


def entropy(by: str, counts: str) -> str:
    return f"""WITH {DOCS}, c AS ({counts}), h AS (SELECT {by}, CAST(sum(cnt) AS BIGINT) AS n_chars, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS h FROM c GROUP BY {by})
SELECT {by}, n_chars, round(h, 6) AS entropy, round(CASE WHEN h > {TOP27!r} + 1e-9 THEN 0 ELSE greatest(0, least(1, 1 - h / {TOP27!r})) END, 6) AS redundancy FROM h"""


SEGMENT = f"""{SPLIT}, m AS ({chars('split', 'train')}), s AS ({chars('split', 'test', 'doc_id')}),
scored AS (SELECT s.doc_id, CAST(sum(s.cnt) AS BIGINT) AS chars, sum(s.cnt * -log2((coalesce(m.cnt, 0) + 1) / ((SELECT sum(cnt) FROM m) + 27))) / sum(s.cnt) AS bpc FROM s LEFT JOIN m USING (ch) GROUP BY s.doc_id)"""


def kneser_ney(order: int, d: float = 0.1) -> str:
    """Common tables whose last, kn, holds events and bpc."""
    pad = "repeat(chr(1), %d)" % (order - 1)
    chunked = lambda col, src: f"SELECT {pad} || substring({col}, j * 1000 + 1, 1000) || {pad} AS s FROM (SELECT {col}, unnest(range(0, CAST(ceil(length({col}) / 1000.0) AS BIGINT))) AS j FROM {src})"
    counted = lambda src: f"SELECT substring(s, i, k) AS g, k, count(*) AS cnt FROM (SELECT s, k, unnest(range(1, length(s) - k + 2)) AS i FROM {src}, (SELECT unnest(range(1, {order + 1})) AS k)) GROUP BY ALL"
    parts = [
        f"kc{order} AS ({chunked('train', 'split')})",
        f"c{order} AS ({counted(f'kc{order}')})",
        f"l{order} AS (SELECT substring(g, 2) AS g, k - 1 AS k, count(*) AS lefts FROM c{order} WHERE k >= 2 GROUP BY 1, 2)",
        f"w{order} AS (SELECT c.g, c.k, CASE WHEN c.k = {order} THEN c.cnt ELSE coalesce(l.lefts, 0) END AS x FROM c{order} c LEFT JOIN l{order} l ON c.g = l.g AND c.k = l.k)",
        f"x{order} AS (SELECT substring(g, 1, k - 1) AS ctx, k, sum(x) AS total, count(*) AS f FROM w{order} GROUP BY 1, 2)",
        f"v{order} AS (SELECT string_agg(g, '') AS known FROM w{order} WHERE k = 1 AND g <> chr(1))",
        f"masked{order} AS (SELECT regexp_replace(test, '[^' || known || ']', chr(1), 'g') AS test FROM split, v{order})",
        f"tc{order} AS ({chunked('test', f'masked{order}')})",
        f"t{order} AS ({counted(f'tc{order}')})",
        f"p{order}_1 AS (SELECT t.g, CAST(coalesce(w.x, 0) AS DOUBLE) / (SELECT total FROM x{order} WHERE k = 1) AS p FROM t{order} t LEFT JOIN w{order} w ON w.g = t.g AND w.k = 1 WHERE t.k = 1)",
    ]
    for k in range(2, order + 1):
        parts.append(f"p{order}_{k} AS (SELECT t.g, CASE WHEN x.total IS NULL THEN q.p ELSE greatest(coalesce(w.x, 0) - CAST({d} AS DOUBLE), 0) / x.total + CAST({d} AS DOUBLE) * x.f / x.total * q.p END AS p FROM t{order} t JOIN p{order}_{k - 1} q ON q.g = substring(t.g, 2) LEFT JOIN x{order} x ON x.k = {k} AND x.ctx = substring(t.g, 1, {k - 1}) LEFT JOIN w{order} w ON w.k = {k} AND w.g = t.g WHERE t.k = {k})")
    union = " UNION ALL ".join(f"SELECT {k} AS k, g, p FROM p{order}_{k}" for k in range(1, order + 1))
    parts.append(f"kn{order} AS (SELECT CAST(sum(t.cnt) AS BIGINT) AS events, sum(t.cnt * -log2(greatest(p, 1e-12))) / sum(t.cnt) AS bpc FROM t{order} t JOIN ({union}) p ON t.g = p.g AND t.k = p.k)")
    return ",\n".join(parts)


def cut_up(depth: int, source: str, column: str, extra: str = "") -> str:
    """Short pieces s of a column, each after off characters of what precedes it."""
    return f"SELECT {extra} least({depth}, j * 128) AS off, substring({column}, greatest(j * 128 + 1 - {depth}, 1), 128 + least({depth}, j * 128)) AS s FROM (SELECT {extra} {column}, unnest(range(0, CAST(ceil(length({column}) / 128.0) AS BIGINT))) AS j FROM {source})"


def contexts(depth: int, source: str, column: str, name: str) -> str:
    """Tables {name}s (ctx, k, sym, cnt) and {name}c (ctx, k, n, u)."""
    return f"""{name}s AS (SELECT substring(s, i - k, k) AS ctx, k, substring(s, i, 1) AS sym, count(*) AS cnt
  FROM (SELECT s, k, unnest(range(greatest(k, off) + 1, length(s) + 1)) AS i FROM ({cut_up(depth, source, column)}), (SELECT unnest(range(0, {depth + 1})) AS k)) GROUP BY ALL),
{name}c AS (SELECT ctx, k, CAST(sum(cnt) AS BIGINT) AS n, count(*) AS u FROM {name}s GROUP BY ctx, k)"""


def ppm(depth: int) -> str:
    """Common tables; pp{depth} has doc_id, events, bits."""
    n = f"q{depth}"
    return f"""{contexts(depth, 'split', 'train', n)},
{n}t AS (SELECT doc_id, substring(s, greatest(i - {depth}, 1), least({depth}, i - 1)) AS ctx, substring(s, i, 1) AS sym, count(*) AS m
  FROM (SELECT doc_id, s, unnest(range(off + 1, length(s) + 1)) AS i FROM ({cut_up(depth, 'split', 'test', 'doc_id,')})) GROUP BY ALL),
{n}l AS (SELECT ctx, sym, k, right(ctx, k) AS lv FROM (SELECT ctx, sym, unnest(range(0, length(ctx) + 1)) AS k FROM (SELECT DISTINCT ctx, sym FROM {n}t))),
{n}p AS (SELECT l.ctx, l.sym, sum(CASE WHEN s.cnt IS NULL THEN -log2(c.u / (c.n + c.u)) ELSE 0 END)
    + coalesce(arg_max(-log2(s.cnt / (c.n + c.u)), CASE WHEN s.cnt IS NOT NULL THEN l.k END), {TOP27!r}) AS bits
  FROM {n}l l JOIN {n}c c ON c.ctx = l.lv AND c.k = l.k LEFT JOIN {n}s s ON s.ctx = l.lv AND s.k = l.k AND s.sym = l.sym GROUP BY l.ctx, l.sym),
pp{depth} AS (SELECT t.doc_id, sum(t.m) AS events, sum(t.m * p.bits) AS bits FROM {n}t t JOIN {n}p p ON t.ctx = p.ctx AND t.sym = p.sym GROUP BY t.doc_id)"""


def scored(model: str, order: int) -> str:
    source = f"SELECT events, bpc FROM kn{order}" if model == "ngram-kn" else f"SELECT CAST(sum(events) AS BIGINT) AS events, sum(bits) / sum(events) AS bpc FROM pp{order}"
    return f"SELECT '{model}' AS model, CAST({order} AS INTEGER) AS \"order\", events, round(bpc, 6) AS bpc FROM ({source})"


def variant(name: str, kind: str, size: int) -> str:
    """Unigram cross-entropy of raw halves on one alphabet."""
    raw = "CAST(floor(length(text) * CAST(0.8 AS DOUBLE)) AS BIGINT)"
    return f"""v_{name} AS (SELECT {norm(kind, f'substring(text, 1, {raw})')} AS train, {norm(kind, f'substring(text, {raw} + 1)')} AS test FROM documents),
m_{name} AS ({chars(f'v_{name}', 'train')}), s_{name} AS ({chars(f'v_{name}', 'test')}),
h_{name} AS (SELECT '{name}' AS variant, CAST({size} AS INTEGER) AS alphabet_size, sum(s.cnt * -log2((coalesce(m.cnt, 0) + 1) / ((SELECT sum(cnt) FROM m_{name}) + {size}))) / sum(s.cnt) AS h FROM s_{name} s LEFT JOIN m_{name} m USING (ch))"""


def huffman(source: str, column: str, name: str) -> str:
    """Recursive common table {name}q, and {name} with ch, cnt, code: two least nodes of a sorted queue become one, until one is left."""
    leaf = "{'f': cnt, 't': rank, 's': [{'ch': ch, 'cnt': cnt, 'code': CASE WHEN total = 1 THEN '0' ELSE '' END}]}"
    coded = lambda i, bit: f"list_transform(q[{i}].s, lambda x: {{'ch': x.ch, 'cnt': x.cnt, 'code': '{bit}' || x.code}})"
    return f"""{name}n AS ({chars(source, column)}),
{name}p AS (SELECT ch, min(doc_id) AS d, arg_min(strpos({column}, ch), doc_id) AS i FROM {source}, {name}n WHERE strpos({column}, ch) > 0 GROUP BY ch),
{name}r AS (SELECT ch, cnt, row_number() OVER (ORDER BY d, i) - 1 AS rank, count(*) OVER () AS total FROM {name}n JOIN {name}p USING (ch)),
{name}q AS (SELECT list_sort(list({leaf})) AS q, count(*) AS nxt FROM {name}r UNION ALL
  SELECT list_sort(list_append(q[3:], {{'f': q[1].f + q[2].f, 't': nxt, 's': list_concat({coded(1, 0)}, {coded(2, 1)})}})), nxt + 1 FROM {name}q WHERE len(q) > 1),
{name} AS (SELECT s.ch AS ch, s.cnt AS cnt, s.code AS code FROM (SELECT unnest(q[1].s) AS s FROM {name}q WHERE len(q) = 1))"""


def joined_ppm(depth: int) -> str:
    """Common tables; jj has events, bpc: contexts of all documents' halves in a row, the last characters before a document standing before its own."""
    n = "j"
    left = lambda c: f"SELECT coalesce(right(string_agg(right({c}, {depth}), '') OVER (ORDER BY doc_id ROWS BETWEEN {depth} PRECEDING AND 1 PRECEDING), {depth}), '') AS l, {c} AS t FROM split WHERE {c} <> ''"
    cut = lambda c: f"SELECT CASE WHEN j = 0 THEN length(l) ELSE {depth} END AS off, CASE WHEN j = 0 THEN l || substring(t, 1, 128) ELSE right(l || substring(t, greatest(j * 128 + 1 - {depth}, 1), least({depth}, j * 128)), {depth}) || substring(t, j * 128 + 1, 128) END AS s FROM (SELECT l, t, unnest(range(0, CAST(ceil(length(t) / 128.0) AS BIGINT))) AS j FROM ({left(c)}))"
    return f"""{n}s AS (SELECT substring(s, i - k, k) AS ctx, k, substring(s, i, 1) AS sym, count(*) AS cnt
  FROM (SELECT s, k, unnest(range(greatest(k, off) + 1, length(s) + 1)) AS i FROM ({cut('train')}), (SELECT unnest(range(0, {depth + 1})) AS k)) GROUP BY ALL),
{n}c AS (SELECT ctx, k, CAST(sum(cnt) AS BIGINT) AS n, count(*) AS u FROM {n}s GROUP BY ctx, k),
{n}t AS (SELECT substring(s, greatest(i - {depth}, 1), least({depth}, i - 1)) AS ctx, substring(s, i, 1) AS sym, count(*) AS m
  FROM (SELECT s, unnest(range(off + 1, length(s) + 1)) AS i FROM ({cut('test')})) GROUP BY ALL),
{n}l AS (SELECT ctx, sym, m, k, right(ctx, k) AS lv FROM (SELECT ctx, sym, m, unnest(range(0, length(ctx) + 1)) AS k FROM {n}t)),
{n}p AS (SELECT l.ctx, l.sym, l.m, sum(CASE WHEN s.cnt IS NULL THEN -log2(c.u / (c.n + c.u)) ELSE 0 END)
    + coalesce(arg_max(-log2(s.cnt / (c.n + c.u)), CASE WHEN s.cnt IS NOT NULL THEN l.k END), {TOP27!r}) AS bits
  FROM {n}l l JOIN {n}c c ON c.ctx = l.lv AND c.k = l.k LEFT JOIN {n}s s ON s.ctx = l.lv AND s.k = l.k AND s.sym = l.sym GROUP BY l.ctx, l.sym, l.m),
jj AS (SELECT CAST(sum(m) AS BIGINT) AS events, sum(m * bits) / sum(m) AS bpc FROM {n}p)"""


def walked(depth: int, source: str, train: str, test: str, exclusion: bool = False) -> str:
    """Common tables; wk has a row for each symbol of the test text with its bits, by nested cases from the longest context down."""
    base = f"log2(CASE WHEN 27 - ex > 0 THEN 27 - ex ELSE 27 END)" if exclusion else f"{TOP27!r}"
    bits = f"CASE WHEN s0.cnt IS NOT NULL THEN -log2(s0.cnt / (c0.n + c0.u)) ELSE -log2(c0.u / (c0.n + c0.u)) + {base} END"
    for k in range(1, depth + 1):
        bits = f"CASE WHEN c{k}.n IS NULL THEN {bits} WHEN s{k}.cnt IS NOT NULL THEN -log2(s{k}.cnt / (c{k}.n + c{k}.u)) ELSE -log2(c{k}.u / (c{k}.n + c{k}.u)) + {bits} END"
    joins = " ".join(f"LEFT JOIN wc c{k} ON c{k}.k = {k} AND length(o.ctx) >= {k} AND c{k}.ctx = right(o.ctx, {k}) LEFT JOIN ws s{k} ON s{k}.k = {k} AND length(o.ctx) >= {k} AND s{k}.ctx = right(o.ctx, {k}) AND s{k}.sym = o.sym" for k in range(1, depth + 1))
    # Excluded are the distinct symbols of the shortest seen context of one symbol or more; longer ones have no others.
    ex = "coalesce(" + ", ".join(f"c{k}.u" for k in range(1, depth + 1)) + ", 0)"
    return f"""{contexts(depth, source, train, 'w')},
wo AS (SELECT substring(s, greatest(i - {depth}, 1), least({depth}, i - 1)) AS ctx, substring(s, i, 1) AS sym FROM (SELECT s, unnest(range(off + 1, length(s) + 1)) AS i FROM ({cut_up(depth, source if test != 'test' else 'split', test)}))),
wk AS (SELECT {bits.replace(' ex ', f' {ex} ').replace('- ex', f'- {ex}')} AS bits FROM wo o {joins} LEFT JOIN wc c0 ON c0.k = 0 LEFT JOIN ws s0 ON s0.k = 0 AND s0.sym = o.sym)"""


#: Scores of the compared models, in the order of the comparison.
SCORED = [("ngram-kn", 2), ("ngram-kn", 3), ("ppm", 2), ("ppm", 3)]
COMPARED = f"""{kneser_ney(2)}, {kneser_ney(3)}, {ppm(2)}, {ppm(3)}, um AS ({chars('split', 'train')}), us AS ({chars('split', 'test')}), {huffman('split', 'train', 'hf')},
f AS ({' UNION ALL '.join(f'SELECT model, "order", exact AS h FROM (SELECT * FROM ({scored(m, n).replace("round(bpc, 6) AS bpc", "bpc AS exact")}))' for m, n in SCORED)}
  UNION ALL SELECT 'unigram', CAST(1 AS INTEGER), sum(us.cnt * -log2((coalesce(um.cnt, 0) + 1) / ((SELECT sum(cnt) FROM um) + 27))) / sum(us.cnt) FROM us LEFT JOIN um USING (ch)
  UNION ALL SELECT 'huffman', CAST(1 AS INTEGER), sum(us.cnt * coalesce(length(hf.code), {TOP27!r})) / sum(us.cnt) FROM us LEFT JOIN hf USING (ch)),
r AS (SELECT model, "order", h, CASE WHEN h > {TOP27!r} + 1e-9 THEN 0 ELSE greatest(0, least(1, 1 - h / {TOP27!r})) END AS redundancy FROM f)"""

#: Poisson(1) draws from the digest of a block and a group of four resamples.
_BOUNDS = list(accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))


def poisson(costs: str, keys: list[str], resamples: int, by: str = "") -> str:
    """Common tables; pb has by and the figures of poisson_bootstrap over costs."""
    lead = f"{by}, " if by else ""
    text = " || ':' || ".join([*(f"CAST({k} AS VARCHAR)" for k in keys), "CAST(g AS VARCHAR)", "'42'"])
    u = "CAST('0x' || substring(digest, CAST(i * 8 + 1 AS BIGINT), 8) AS BIGINT) / 4294967296.0::DOUBLE"
    times = " + ".join(f"(CASE WHEN u >= {b!r} THEN 1 ELSE 0 END)" for b in _BOUNDS)
    return f"""pd AS (SELECT {lead}events, bits, g * 4 + i AS r, {u} AS u FROM (SELECT {lead}events, bits, g, md5({text}) AS digest FROM {costs}, (SELECT unnest(range(0, {(resamples - 1) // 4 + 1})) AS g)), (SELECT unnest(range(0, 4)) AS i)),
pt AS (SELECT {lead}r, sum((({times})) * bits) / sum((({times})) * events) AS h FROM pd WHERE r < {resamples} AND u >= {_BOUNDS[0]!r} GROUP BY {lead}r),
pb AS (SELECT {lead}round(avg(h), 6) AS mean_bpc, round(stddev_samp(h), 6) AS std_bpc, round(quantile_cont(h, 0.025), 6) AS ci_lower_bpc, round(quantile_cont(h, 0.975), 6) AS ci_upper_bpc FROM pt {f'GROUP BY {by}' if by else ''})"""


def block_scores(extra: str = "") -> str:
    """Common tables; bs has doc_id, block_id, events, bits of the blocks of all test halves."""
    return f"""m AS ({chars('split', 'train')}), b AS (SELECT {extra} doc_id, j AS block_id, substring(test, j * 2000 + 1, 2000) AS t FROM (SELECT {extra} doc_id, test, unnest(range(0, CAST(ceil(length(test) / 2000.0) AS BIGINT))) AS j FROM split)),
s AS ({chars('b', 't', f'{extra} doc_id, block_id')}), bs AS (SELECT {extra} doc_id, block_id, sum(s.cnt) AS events, sum(s.cnt * -log2((coalesce(m.cnt, 0) + 1) / ((SELECT sum(cnt) FROM m) + 27))) AS bits FROM s LEFT JOIN m USING (ch) GROUP BY {extra} doc_id, block_id)"""


TRIGRAMS = f"""{DOCS}, ch AS (SELECT repeat(chr(1), 2) || substring(t, j * 1000 + 1, 1000) || repeat(chr(1), 2) AS s FROM (SELECT t, unnest(range(0, CAST(ceil(length(t) / 1000.0) AS BIGINT))) AS j FROM docs)),
g AS (SELECT substring(s, i, 3) AS gram, count(*) AS cnt FROM (SELECT s, unnest(range(1, length(s) - 1)) AS i FROM ch) GROUP BY gram)"""
TOP = f"{DOCS}, {contexts(3, 'docs', 't', 'f')}, top AS (SELECT ctx, CAST(k AS INTEGER) AS k, n FROM fc WHERE k > 0 ORDER BY n DESC, k, ctx LIMIT 100)"


def oracle_sql() -> dict[str, str]:
    out = {f"normalize_{k}": f"SELECT doc_id, {norm(k)} AS norm FROM documents" for k in ("en27", "en26", "ro32", "punct")}
    out["alphabet_coverage_raw"] = "SELECT lang, round(sum(length(regexp_replace(text, '[^a-z ]', '', 'g'))) / sum(length(text)), 6) AS coverage FROM documents GROUP BY lang"
    out["to_indices"] = f"WITH {DOCS}, e AS (SELECT doc_id, c, i FROM (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM docs WHERE t <> '')) SELECT d.doc_id, CAST(length(d.t) AS BIGINT) AS n, CAST(coalesce(sum((CASE WHEN c = ' ' THEN 26 ELSE ascii(c) - 97 END) * ((i - 1) % 1000 + 1)), 0) AS BIGINT) AS checksum FROM docs d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id, d.t"
    out["document_digests"] = f"WITH {DOCS} SELECT doc_id, sha256(t) AS sha256 FROM docs"
    out["train_test_split"] = f"WITH {SPLIT} SELECT doc_id, CAST(length(train) AS INTEGER) AS n_train, CAST(length(test) AS INTEGER) AS n_test, md5(train) AS train_md5, md5(test) AS test_md5 FROM split"
    out["char_frequencies"] = f"WITH {DOCS} {chars('docs', 't')}"
    out["char_frequencies_by_lang"] = f"WITH {DOCS} {chars('docs', 't', 'lang')}"
    out["unigram_entropy_by_lang"] = entropy("lang", chars("docs", "t", "lang"))
    out["unigram_entropy_by_source"] = entropy("source", chars("docs", "t", "source"))
    out["unigram_cross_entropy"] = f"""WITH {SPLIT}, m AS ({chars('split', 'train', 'lang')}), s AS ({chars('split', 'test', 'lang')}), n AS (SELECT lang, sum(cnt) AS total FROM m GROUP BY lang)
SELECT s.lang, CAST(sum(s.cnt) AS BIGINT) AS test_chars, round(sum(s.cnt * -log2((coalesce(m.cnt, 0) + 1) / (n.total + 27))) / sum(s.cnt), 6) AS bpc FROM s JOIN n ON s.lang = n.lang LEFT JOIN m ON s.lang = m.lang AND s.ch = m.ch GROUP BY s.lang"""
    out["per_segment_cross_entropy"] = f"WITH {SEGMENT} SELECT doc_id, chars, round(bpc, 6) AS bpc FROM scored"
    out["per_segment_means"] = f"WITH {SEGMENT} SELECT round(avg(bpc), 6) AS unweighted_mean_bpc, round(sum(bpc * chars) / sum(chars), 6) AS weighted_mean_bpc, count(*) AS segments FROM scored"
    out["ngram_counts_k3"] = f"WITH {TRIGRAMS} SELECT gram, cnt FROM g"
    out["continuation_counts"] = f"WITH {TRIGRAMS} SELECT substring(gram, 2) AS gram, count(*) AS lefts FROM g GROUP BY 1"
    for n in (2, 3, 5):
        out[f"kn_cross_entropy_o{n}"] = f"WITH {SPLIT}, {kneser_ney(n)} {scored('ngram-kn', n)}"
    for n in (3, 5):
        out[f"ppm_cross_entropy_d{n}"] = f"WITH {SPLIT}, {ppm(n)} {scored('ppm', n)}"
    out["ppm_per_segment_d3"] = f"WITH {SPLIT}, {ppm(3)} SELECT doc_id, CAST(events AS BIGINT) AS chars, round(bits / events, 6) AS bpc FROM pp3"
    out["ppm_codelength_verify"] = f"WITH {SPLIT}, {ppm(2)}, {walked(2, 'split', 'train', 'test')}, h AS (SELECT (SELECT sum(bits) / sum(events) FROM pp2) AS h, (SELECT avg(bits) FROM wk) AS w) SELECT round(h, 6) AS cross_entropy_bpc, round(w, 6) AS codelength_bpc, abs(h - w) < 1e-3 AS matches FROM h"
    out["ppm_cross_entropy_concat_d3"] = f"WITH {SPLIT}, {joined_ppm(3)} SELECT 'ppm' AS model, CAST(3 AS INTEGER) AS \"order\", events, round(bpc, 6) AS bpc FROM jj"
    out["ppm_self_entropy_d2"] = f"WITH {DOCS}, {walked(2, 'docs', 't', 't')} SELECT 'ppm' AS model, CAST(2 AS INTEGER) AS \"order\", count(*) AS events, round(avg(bits), 6) AS bpc FROM wk"
    mixed = "d1 AS (SELECT translate(t, 'qxz', '   ') AS train FROM docs WHERE lang = 'de'), d2 AS (SELECT t AS test FROM docs WHERE lang <> 'de')"
    out["ppm_update_exclusion_d2"] = f"WITH {DOCS}, {mixed}, {walked(2, 'd1', 'train', 'test', True).replace('FROM split', 'FROM d2')} SELECT 'ppm' AS model, CAST(2 AS INTEGER) AS \"order\", count(*) AS events, round(avg(bits), 6) AS bpc FROM wk"
    top = kneser_ney(3)
    top = top[: top.index("kn3 AS (")] + 'kn3 AS (SELECT CAST(sum(t.cnt) AS BIGINT) AS events, sum(t.cnt * -log2(greatest(p.p, 1e-12))) / sum(t.cnt) AS bpc FROM t3 t JOIN p3_3 p USING (g) WHERE t.k = 3)'
    out["kn_top_o3"] = f"WITH {SPLIT}, {top} {scored('ngram-kn', 3)}"
    whole = "joined AS (SELECT string_agg(train, '' ORDER BY doc_id) AS train, string_agg(test, '' ORDER BY doc_id) AS test FROM split)"
    out["kn_cross_entropy_concat_o2"] = f"WITH {SPLIT}, {whole}, {kneser_ney(2).replace('FROM split', 'FROM joined')} {scored('ngram-kn', 2)}"
    out["huffman_code_lengths"] = f"WITH RECURSIVE {DOCS}, {huffman('docs', 't', 'hf')} SELECT ch, cnt, code, CAST(length(code) AS INTEGER) AS code_len FROM hf"
    out["huffman_cross_entropy"] = f"WITH RECURSIVE {SPLIT}, {huffman('split', 'train', 'hf')}, us AS ({chars('split', 'test')}) SELECT 'huffman' AS model, CAST(1 AS INTEGER) AS \"order\", CAST(sum(us.cnt) AS BIGINT) AS events, round(sum(us.cnt * coalesce(length(hf.code), {TOP27!r})) / sum(us.cnt), 6) AS bpc FROM us LEFT JOIN hf USING (ch)"
    out["huffman_metadata"] = f"WITH RECURSIVE {DOCS}, {huffman('docs', 't', 'hf')} SELECT round(sum(cnt * length(code)) / sum(cnt), 6) AS avg_code_length, CAST(max(length(code)) AS INTEGER) AS max_code_length, CAST(count(*) AS INTEGER) AS unique_chars FROM hf"
    out["coder_sizes"] = f"""WITH {SPLIT}, {walked(2, 'split', 'train', 'test')}, um AS ({chars('split', 'train')}), us AS ({chars('split', 'test')}),
z AS (SELECT 'ppm' AS model, sum(bits) AS bits FROM wk UNION ALL SELECT 'unigram', sum(us.cnt * -log2((coalesce(um.cnt, 0) + 1) / ((SELECT sum(cnt) FROM um) + 27))) FROM us LEFT JOIN um USING (ch))
SELECT model, round(bits, 2) AS bits, CAST(greatest(1, (CAST(ceil(bits) AS BIGINT) + 7) // 8) AS BIGINT) AS payload_bytes FROM z"""
    out["validate_alphabet"] = "SELECT CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) - length(regexp_replace(text, '[^a-z ]', '', 'g'))) AS BIGINT) AS outside FROM documents"
    out["span_segments"] = f"WITH {DOCS}, h AS (SELECT doc_id, t, length(t) // 2 AS half FROM docs), p AS (SELECT doc_id, 0 AS seg_id, substring(t, 1, half) AS p FROM h UNION ALL SELECT doc_id, 1, substring(t, half + 1) FROM h) SELECT doc_id, CAST(seg_id AS BIGINT) AS seg_id, CAST(length(p) AS INTEGER) AS n, md5(p) AS md5 FROM p WHERE p <> ''"
    out["chunk_table"] = f"WITH {DOCS}, c AS (SELECT doc_id, j, substring(t, j * 1000 + 1, 1000) AS p FROM (SELECT doc_id, t, unnest(range(0, CAST(ceil(length(t) / 1000.0) AS BIGINT))) AS j FROM docs)) SELECT doc_id, CAST(j AS INTEGER) AS chunk_id, CAST(length(p) AS INTEGER) AS n, md5(p) AS md5 FROM c"
    out["indices_round_trip"] = f"WITH {DOCS} SELECT doc_id, md5(t) AS md5 FROM docs"
    for k in ("plain", "readable", "gzip", "zip", "bz2", "tgz", "jsonl"):
        out[f"source_{k}"] = "SELECT CAST(length(coalesce(text, '')) AS INTEGER) AS n, md5(coalesce(text, '')) AS md5 FROM documents" + " WHERE text <> ''" * (k in ("plain", "readable"))
    out["bootstrap_poisson_ci"] = f"WITH {SPLIT}, {block_scores()}, {poisson('bs', ['doc_id', 'block_id'], 1000)} SELECT * FROM pb"
    sourced = SPLIT.replace("SELECT doc_id, lang, substring", "SELECT doc_id, source, substring")
    out["segment_bootstrap_means"] = f"WITH {sourced}, {block_scores('source,')}, {poisson('bs', ['source', 'doc_id', 'block_id'], 100, 'source')} SELECT * FROM pb"
    out["source_tagged"] = r"WITH w AS (SELECT array_to_string(list_filter(regexp_split_to_array(text, '[\s\v]+'), lambda x: x <> ''), ' ') AS t FROM documents WHERE text <> '') SELECT CAST(length(t) AS INTEGER) AS n, md5(t) AS md5 FROM w"
    out["source_wikipedia"] = f"WITH {DOCS} SELECT doc_id, md5('Heading' || chr(10) || coalesce(t, '') || '   shown') AS md5 FROM docs"
    out["results_scan"] = f"WITH RECURSIVE {SPLIT}, {COMPARED} SELECT model || '_order' || \"order\" || '.json' AS file_name, model, \"order\", round(h, 6) AS bits_per_char, round(redundancy, 6) AS redundancy FROM r"
    out["saved_ppm_d3"] = out["ppm_cross_entropy_d3"]
    out["redundancy_comparison"] = f"WITH RECURSIVE {SPLIT}, {COMPARED} SELECT model, \"order\", round(h, 6) AS bits_per_char, round({TOP27!r}, 6) AS log2_alphabet_size, round(redundancy, 6) AS redundancy, round({TOP27!r} / h, 6) AS compression_ratio FROM r"
    out["redundancy_gains"] = f"WITH RECURSIVE {SPLIT}, {COMPARED}, g AS (SELECT max(redundancy) FILTER (model = 'huffman') AS h, max(redundancy) FILTER (model LIKE 'ngram%') AS n, max(redundancy) FILTER (model = 'ppm') AS p FROM r) SELECT round(h, 6) AS huffman_redundancy, round(n, 6) AS ngram_redundancy, round(p, 6) AS ppm_redundancy, round(n - h, 6) AS huffman_to_ngram_gain, round(p - h, 6) AS huffman_to_ppm_gain, round(p - n, 6) AS ngram_to_ppm_gain FROM g"
    line = f"model || ',' || CAST(\"order\" AS VARCHAR) || ',' || printf('%.6f', h) || ',' || printf('%.6f', {TOP27!r}) || ',' || printf('%.6f', redundancy) || ',' || printf('%.6f', {TOP27!r} / h)"
    out["comparison_lines"] = f"WITH RECURSIVE {SPLIT}, {COMPARED} SELECT row_number() OVER (ORDER BY h DESC, model, \"order\") AS line, {line} AS text FROM r UNION ALL SELECT 0, 'model,order,bits_per_char,log2_alphabet_size,redundancy,compression_ratio'"
    out["ppm_context_stats"] = f"WITH {DOCS}, {contexts(3, 'docs', 't', 'f')} SELECT CAST(k AS INTEGER) AS k, count(*) AS contexts, CAST(sum(n) AS BIGINT) AS total, CAST(sum(u) AS BIGINT) AS symbols FROM fc GROUP BY k"
    out["ppm_top_contexts"] = f"WITH {TOP} SELECT ctx, k, n FROM top"
    out["ppm_context_edges"] = f"WITH {TOP} SELECT p.ctx AS parent, c.ctx AS child FROM top c JOIN top p ON p.ctx = substring(c.ctx, 2)"
    out["best_model_per_family"] = f"""WITH {SPLIT}, {kneser_ney(2)}, {kneser_ney(3)}, {ppm(2)}, {ppm(3)}, um AS ({chars('split', 'train')}), us AS ({chars('split', 'test')}),
f AS ({' UNION ALL '.join(scored(m, n) for m, n in (('ngram-kn', 2), ('ngram-kn', 3), ('ppm', 2), ('ppm', 3)))}
  UNION ALL SELECT 'unigram', CAST(1 AS INTEGER), CAST(sum(us.cnt) AS BIGINT), round(sum(us.cnt * -log2((coalesce(um.cnt, 0) + 1) / ((SELECT sum(cnt) FROM um) + 27))) / sum(us.cnt), 6) FROM us LEFT JOIN um USING (ch))
SELECT model, "order", bpc AS bits_per_char FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY bpc, "order" DESC) AS rn FROM f) WHERE rn = 1"""
    out["block_costs"] = f"""WITH {SPLIT}, m AS ({chars('split', 'train')}), b AS (SELECT doc_id, j AS block_id, substring(test, j * 2000 + 1, 2000) AS t FROM (SELECT doc_id, test, unnest(range(0, CAST(ceil(length(test) / 2000.0) AS BIGINT))) AS j FROM split)),
s AS ({chars('b', 't', 'doc_id, block_id')}) SELECT doc_id, CAST(block_id AS INTEGER) AS block_id, CAST(sum(s.cnt) AS BIGINT) AS events, round(sum(s.cnt * -log2((coalesce(m.cnt, 0) + 1) / ((SELECT sum(cnt) FROM m) + 27))), 6) AS bits FROM s LEFT JOIN m USING (ch) GROUP BY doc_id, block_id"""
    out["sensitivity_unigram"] = f"""WITH {variant('baseline', 'en27', 27)}, {variant('no_space', 'en26', 26)}, {variant('with_punctuation', 'punct', 42)},
a AS (SELECT * FROM h_baseline UNION ALL SELECT * FROM h_no_space UNION ALL SELECT * FROM h_with_punctuation)
SELECT variant, alphabet_size, round(h, 6) AS bits_per_char, round(h - (SELECT h FROM h_baseline), 6) AS delta_bpc FROM a"""
    out["corpus_datacard"] = f"""WITH {DOCS}, u AS ({chars('docs', 't')}) SELECT (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) FROM documents) AS raw_size_bytes, (SELECT CAST(sum(octet_length(encode(t))) AS BIGINT) FROM docs) AS processed_size_bytes,
(SELECT CAST(sum(length(t)) AS BIGINT) FROM docs) AS char_count, (SELECT string_agg(ch, '' ORDER BY ch) FROM u) AS unique_chars, CAST(1.0 AS DOUBLE) AS alphabet_coverage,
(SELECT round(sum(length(regexp_replace(text, '[^a-z ]', '', 'g'))) / sum(length(text)), 6) FROM documents) AS raw_coverage"""
    joined = "(SELECT d.t, l.quality FROM docs d JOIN labels l USING (doc_id))"
    out["entropy_by_label"] = entropy("quality", chars(joined, "t", "quality"))
    said = f"(SELECT role, {norm()} AS t FROM conversations)"
    out["conversation_entropy_by_role"] = entropy("role", chars(said, "t", "role"))
    out["event_type_entropy"] = "WITH c AS (SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type) SELECT CAST(sum(cnt) AS BIGINT) AS n, count(*) AS types, round(log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt), 6) AS entropy FROM c"
    return out
