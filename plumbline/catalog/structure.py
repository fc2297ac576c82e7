"""Correlation, entropy, spectrum and separability of two sides."""

from pyspark.sql import functions as F

from ..operators import classifier as L, correlation as R, entropy as E, spectral as S
from ..session import table
from .compare import core, histogram_ctes
from .fixtures import LONG_SQL, ORDER_COLS, PAIR_COLS, PAIR_SQL, lineitem_pair
from .registry import query

PAIRS = [(a, b) for i, a in enumerate(PAIR_COLS) for b in PAIR_COLS[i + 1:]]

SIDES = f"p AS ({PAIR_SQL}), cc AS (" + " UNION ALL ".join(
    f"SELECT validation_id, '{a}' AS col_a, '{b}' AS col_b, coalesce(corr({a}, {b}) FILTER (side = 'syn'), 0) AS r_s,"
    f" coalesce(corr({a}, {b}) FILTER (side = 'orig'), 0) AS r_o FROM p GROUP BY 1" for a, b in PAIRS) + ")"
FROB = """fr AS (SELECT validation_id, 100.0 * (1.0 - least(1.0, sqrt(2 * sum((r_s - r_o) ** 2)) / (sqrt(2 * sum(r_o ** 2) + 4) + 1e-8))) AS frobenius_similarity FROM cc GROUP BY 1)"""
COC = """co AS (SELECT validation_id, (coalesce(corr(r_s, r_o), 0) + 1) / 2 * 100 AS corr_of_corr FROM cc GROUP BY 1)"""


@query("correlation_sides", f"WITH {SIDES} SELECT * FROM cc", 8, "r_s r_o")
def _(spark, d):
    return R.correlation_sides(core(spark, d), PAIR_COLS)


@query("frobenius_similarity", f"WITH {SIDES}, {FROB} SELECT * FROM fr", 6, "frobenius_similarity")
def _(spark, d):
    pair = core(spark, d)
    return R.frobenius_similarity(R.correlation_sides(pair, PAIR_COLS), R.constant_columns(pair, PAIR_COLS))


@query("corr_of_corr", f"WITH {SIDES}, {COC} SELECT * FROM co", 6, "corr_of_corr")
def _(spark, d):
    return R.corr_of_corr(R.correlation_sides(core(spark, d), PAIR_COLS))


# eight columns give 28 pairs, so the ten strongest are a real selection
WIDE = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_orderkey"]
WIDE_PAIRS = [(a, b) for i, a in enumerate(WIDE) for b in WIDE[i + 1:]]
TOPC = "cc AS (" + " UNION ALL ".join(
    f"SELECT l_returnflag AS validation_id, '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) FILTER (l_linestatus = 'O') AS r_s,"
    f" corr({a}, {b}) FILTER (l_linestatus = 'F') AS r_o FROM lineitem GROUP BY 1" for a, b in WIDE_PAIRS) + ")"


@query("top_correlations_preserved", f"""WITH {TOPC} SELECT validation_id, 100.0 * count_if(s <= 10 AND o <= 10) / 10 AS top_correlations_preserved FROM (
 SELECT validation_id, row_number() OVER (PARTITION BY validation_id ORDER BY abs(r_s) DESC, col_a, col_b) AS s,
  row_number() OVER (PARTITION BY validation_id ORDER BY abs(r_o) DESC, col_a, col_b) AS o FROM cc) GROUP BY 1""", 6, "top_correlations_preserved")
def _(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("validation_id"), F.when(F.col("l_linestatus") == "O", "syn").otherwise("orig").alias("side"), *WIDE
    )
    return R.top_correlations_preserved(R.correlation_sides(li, WIDE))


@query("correlation_preservation", f"""WITH {SIDES}, {FROB}, {COC} SELECT *, score >= 70 AS passed FROM (SELECT validation_id, frobenius_similarity, corr_of_corr,
 100.0 AS top_correlations_preserved, 0.4 * frobenius_similarity + 0.4 * corr_of_corr + 20.0 AS score FROM fr JOIN co USING (validation_id))""", 6,
       "frobenius_similarity corr_of_corr top_correlations_preserved score")
def correlation(spark, d):
    return R.correlation_preservation(core(spark, d), PAIR_COLS)


ENT = f"""p AS ({PAIR_SQL}), lng AS ({LONG_SQL}), {histogram_ctes(50, 'own')},
en AS (SELECT validation_id, col, -sum(ps * ln(ps)) AS h_s, -sum(po * ln(po)) AS h_o FROM (
 SELECT validation_id, col, (cs + 1e-10) / sum(cs + 1e-10) OVER v AS ps, (co + 1e-10) / sum(co + 1e-10) OVER v AS po FROM hg WINDOW v AS (PARTITION BY validation_id, col)) GROUP BY ALL)"""


@query("column_entropies", f"WITH {ENT} SELECT * FROM en", 6, "h_s h_o")
def _(spark, d):
    return E.column_entropies(core(spark, d), PAIR_COLS)


@query("entropy_ratio", f"WITH {ENT} SELECT validation_id, r AS entropy_ratio, 100.0 * exp(-abs(r - 1)) AS entropy_score FROM (SELECT validation_id, avg(h_s) / (avg(h_o) + 1e-10) AS r FROM en GROUP BY 1)", 6, "entropy_ratio entropy_score")
def _(spark, d):
    return E.entropy_ratio(E.column_entropies(core(spark, d), PAIR_COLS))


@query("diversity_retention", f"WITH {ENT} SELECT validation_id, col, 100.0 * least(1.0, h_s / h_o) AS retention, h_s / h_o < 0.8 AS collapsed FROM en", 6, "retention")
def _(spark, d):
    return E.diversity_retention(E.column_entropies(core(spark, d), PAIR_COLS))


def mi_branch(a: str, b: str) -> str:
    cell = "least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 10), 9)"
    return f"""SELECT validation_id, side, '{a}' AS col, {cell.format(c=a)} AS i, {cell.format(c=b)} AS j FROM p JOIN rr USING (validation_id)"""


MI = f"""p AS ({PAIR_SQL}), rr AS (SELECT validation_id, {", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in PAIR_COLS)} FROM p GROUP BY 1),
cl AS ({" UNION ALL ".join(mi_branch(c, PAIR_COLS[(k + 1) % len(PAIR_COLS)]) for k, c in enumerate(PAIR_COLS))}),
nn AS (SELECT validation_id, side, col, i, j, count(*) AS n FROM cl GROUP BY ALL),
pp AS (SELECT *, n / sum(n) OVER g AS pij, sum(n) OVER (PARTITION BY validation_id, side, col, i) / sum(n) OVER g AS pi,
 sum(n) OVER (PARTITION BY validation_id, side, col, j) / sum(n) OVER g AS pj FROM nn WINDOW g AS (PARTITION BY validation_id, side, col)),
mi AS (SELECT validation_id, col, greatest(0, sum(pij * ln(pij / (pi * pj))) FILTER (side = 'syn')) AS mi_s,
 greatest(0, sum(pij * ln(pij / (pi * pj))) FILTER (side = 'orig')) AS mi_o FROM pp GROUP BY ALL)"""


@query("mutual_information", f"WITH {MI} SELECT * FROM mi", 7, "mi_s mi_o")
def _(spark, d):
    return E.mutual_information(core(spark, d), PAIR_COLS)


@query("mi_preservation", f"WITH {MI} SELECT validation_id, avg(CASE WHEN mi_o > 1e-6 THEN 100.0 * exp(-abs(mi_s / (mi_o + 1e-10) - 1)) ELSE 100.0 END) AS mi_preservation FROM mi GROUP BY 1", 5, "mi_preservation")
def _(spark, d):
    return E.mi_preservation(E.mutual_information(core(spark, d), PAIR_COLS))


@query("effective_dimensions")
def _(spark, d):
    return E.effective_dimensions(core(spark, d), PAIR_COLS)


@query("entropy_stability")
def _(spark, d):
    return E.entropy_stability(core(spark, d), PAIR_COLS)


RARE_COLS = ["disc", "tax"]
RARE_SQL = f"""WITH p AS ({PAIR_SQL}),
o AS (SELECT validation_id, disc, tax, n / sum(n) OVER (PARTITION BY validation_id) AS share FROM (SELECT validation_id, disc, tax, count(*) AS n FROM p WHERE side = 'orig' GROUP BY ALL)),
s AS (SELECT DISTINCT validation_id, disc, tax, 1 AS kept FROM p WHERE side = 'syn')
SELECT validation_id, count(*) AS rare_patterns, 100.0 * count(kept) / count(*) AS rare_retention FROM (SELECT * FROM o WHERE share < 0.01) LEFT JOIN s USING (validation_id, disc, tax) GROUP BY 1"""


@query("rare_retention", RARE_SQL, 6, "rare_retention")
def _(spark, d):
    return E.rare_retention(core(spark, d), RARE_COLS, 0.01)


BLOCK = 64
SPEC_COLS = ["q", "x"]
# a direct Fourier sum per block; the last block is padded with zeros
PSD = f"""p AS ({PAIR_SQL}), ix AS (SELECT *, row_number() OVER (PARTITION BY validation_id, side ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS r FROM p),
ln2 AS (SELECT validation_id, side, r // {BLOCK} AS b, r % {BLOCK} AS t, unnest(['q', 'x']) AS col, unnest([q, x]) AS v FROM ix),
ft AS (SELECT validation_id, side, col, b, k, sum(v * cos(2 * pi() * k * t / {BLOCK})) AS re, sum(v * sin(2 * pi() * k * t / {BLOCK})) AS im
 FROM ln2, range({BLOCK // 2 + 1}) AS f(k) GROUP BY ALL),
ps AS (SELECT validation_id, side, col, k AS freq, avg(re * re + im * im) AS power FROM ft GROUP BY ALL),
sd AS (SELECT validation_id, col, freq, coalesce(max(power) FILTER (side = 'syn'), 0) AS p_s, coalesce(max(power) FILTER (side = 'orig'), 0) AS p_o FROM ps GROUP BY ALL),
s1 AS (SELECT validation_id, avg(abs(p_s - p_o)) AS spectral_distance FROM sd GROUP BY 1),
s2 AS (SELECT validation_id, 100.0 * avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS dominant_frequency_match FROM (
 SELECT validation_id, col, arg_max(freq, p_s) AS a, arg_max(freq, p_o) AS b FROM sd GROUP BY ALL) GROUP BY 1),
s3 AS (SELECT validation_id, avg(hs) / (avg(ho) + 1e-10) AS spectral_entropy_ratio FROM (SELECT validation_id, col, -sum(s * ln(s + 1e-10)) AS hs, -sum(o * ln(o + 1e-10)) AS ho FROM (
 SELECT validation_id, col, p_s / sum(p_s) OVER v AS s, p_o / sum(p_o) OVER v AS o FROM sd WINDOW v AS (PARTITION BY validation_id, col)) GROUP BY ALL) GROUP BY 1)"""


def spec_pair(spark, d):
    return lineitem_pair(spark, d)


@query("psd", f"WITH {PSD} SELECT validation_id, side, col, freq, power FROM ps", 2, "power")
def _(spark, d):
    return S.psd(spec_pair(spark, d), SPEC_COLS, ORDER_COLS, BLOCK)


@query("spectral_similarity", f"WITH {PSD} SELECT validation_id, spectral_distance, 100.0 * exp(-spectral_distance / 1000) AS spectral_similarity FROM s1", 4, "spectral_distance spectral_similarity")
def _(spark, d):
    return S.spectral_similarity(S.psd_sides(S.psd(spec_pair(spark, d), SPEC_COLS, ORDER_COLS, BLOCK)))


@query("dominant_frequency_match", f"WITH {PSD} SELECT * FROM s2", 4, "dominant_frequency_match")
def _(spark, d):
    return S.dominant_frequency_match(S.psd_sides(S.psd(spec_pair(spark, d), SPEC_COLS, ORDER_COLS, BLOCK)))


@query("spectral_entropy_ratio", f"WITH {PSD} SELECT validation_id, spectral_entropy_ratio, 100.0 * exp(-abs(spectral_entropy_ratio - 1)) AS spectral_entropy_score FROM s3", 5, "spectral_entropy_ratio spectral_entropy_score")
def _(spark, d):
    return S.spectral_entropy_ratio(S.psd_sides(S.psd(spec_pair(spark, d), SPEC_COLS, ORDER_COLS, BLOCK)))


@query("spectral_coherence", f"""WITH {PSD} SELECT *, score >= 70 AS passed FROM (SELECT *, least(100.0, greatest(0.0, 0.4 * spectral_similarity + 0.3 * dominant_frequency_match + 0.3 * spectral_entropy_score)) AS score FROM (
 SELECT validation_id, spectral_distance, dominant_frequency_match, spectral_entropy_ratio, 100.0 * exp(-spectral_distance / 1000) AS spectral_similarity,
 100.0 * exp(-abs(spectral_entropy_ratio - 1)) AS spectral_entropy_score FROM s1 JOIN s2 USING (validation_id) JOIN s3 USING (validation_id)))""", 4,
       "spectral_distance dominant_frequency_match spectral_entropy_ratio spectral_similarity spectral_entropy_score score")
def _(spark, d):
    return S.spectral_coherence(spec_pair(spark, d), SPEC_COLS, ORDER_COLS, BLOCK)


@query("spectral_coherence_long_blocks")
def _(spark, d):
    return S.spectral_coherence(spec_pair(spark, d), PAIR_COLS, ORDER_COLS, normalise=True)


REPR = """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS t, len(embedding) AS d FROM embeddings),
s AS (SELECT vec_id, label, -sum(p * ln(p + 1e-10)) AS h FROM (SELECT vec_id, label, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM v) GROUP BY ALL),
f AS (SELECT vec_id, label, k, sum(x * cos(2 * pi() * k * t / d)) ** 2 + sum(x * sin(2 * pi() * k * t / d)) ** 2 AS pw FROM v, range(33) AS r(k) GROUP BY ALL)
SELECT label, avg(x * x) AS spectral_energy, any_value(e) AS spectral_entropy, any_value(fc) AS frequency_concentration, var_samp(x) AS representation_variance
FROM v JOIN (SELECT label, avg(h) AS e FROM s GROUP BY 1) USING (label) JOIN (SELECT label, max(pw) / avg(pw) AS fc FROM f GROUP BY 1) USING (label) GROUP BY label"""


@query("representation_metrics", REPR, 5, "spectral_energy spectral_entropy frequency_concentration representation_variance")
def _(spark, d):
    return S.representation_metrics(table(spark, d, "embeddings"), "embedding", ["label"])


@query("distinguishability")
def _(spark, d):
    return L.distinguishability(lineitem_pair(spark, d), PAIR_COLS, ORDER_COLS)


@query("generalization_gap")
def _(spark, d):
    return L.generalization_gap(L.distinguishability(lineitem_pair(spark, d), PAIR_COLS, ORDER_COLS))
