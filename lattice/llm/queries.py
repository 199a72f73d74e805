"""The registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.catalog import table
from lattice.llm import langid, media, mixing, neardup, packing, phrases, ppm, preference, quality, runs, secrets, substring, url_filter

#: Target weights: four curated sources count double, the hot one is held at a tenth, all others share the rest.
MIX_WEIGHTS = {"src0": 0.10, "src1": 0.10, "src2": 0.10, "src3": 0.10, "src4": 0.10, mixing.OTHER: 0.50}

URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Kinds of unwanted hosts and the domains they stand under; with one page they are the list that blocks where no rule decides.
URL_UNWANTED = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
URL_DOMAINS = tuple(f"{name}.{end}" for name in ("example", "test", "invalid") for end in ("com", "net", "org", "info", "biz", "de", "en", "es", "fr", "it"))
URL_BLOCKED = (*(f"{kind}.{domain}" for kind in URL_UNWANTED for domain in URL_DOMAINS), "m.free-bets.example.net/de/20")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "source", "text", "mix_bucket", F.round("mix_rate", 9).alias("mix_rate"), "mix_copies", "mix_copy", "mix_key")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs, model, keep=(langid.held_out().alias("held_out"),))
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_verdicts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance"))


def op6_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(table(spark, sf_dir, "documents")), texts=False)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate_substrings(table(spark, sf_dir, "documents"), keep_text=False)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return preference.format_preferences(turns, F.shiftright("conv_id", 1), F.col("conv_id") % 2 == 0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = spark.createDataFrame([(b,) for b in URL_BLOCKED], "entry string")
    judged = url_filter.url_filter(table(spark, sf_dir, "pages"), blocked, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out(folds=5)
    trained = ppm.train(docs.where(~held_out))
    return ppm.score_documents(docs, trained, keep=(held_out.alias("held_out"),))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), tails=True, keep_text=False)


def _mix_sql() -> str:
    named = ", ".join(f"'{s}'" for s in MIX_WEIGHTS if s != mixing.OTHER)
    weights = ", ".join(f"('{s}', {w}::DOUBLE)" for s, w in MIX_WEIGHTS.items())
    return f"""
WITH d AS (
  SELECT doc_id, source, text, CASE WHEN source IN ({named}) THEN source ELSE '*' END AS mix_bucket,
         coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS ident
  FROM documents),
w(mix_bucket, weight) AS (VALUES {weights}),
m AS (SELECT mix_bucket, sum(strlen(coalesce(text, '')))::DOUBLE AS mass FROM d GROUP BY 1),
s AS (SELECT m.mix_bucket, m.mass, w.weight, sum(m.mass) OVER () AS corpus, sum(w.weight) OVER () AS share FROM m JOIN w USING (mix_bucket)),
r AS (SELECT mix_bucket, weight / share * 1.0 * corpus / mass AS rate FROM s),
p AS (
  SELECT mix_bucket, rate, k, least(1.0, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY mix_bucket ORDER BY k)) AS cdf
  FROM r, LATERAL (SELECT unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT)) AS k)),
c AS (
  SELECT d.*, r.rate, ('0x' || substr(md5('17|count|' || ident), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN r USING (mix_bucket)),
n AS (SELECT c.*, (SELECT count(*) FROM p WHERE p.mix_bucket = c.mix_bucket AND p.cdf <= c.u) AS mix_copies FROM c)
SELECT doc_id, source, text, mix_bucket, round(rate, 9) AS mix_rate, mix_copies, k AS mix_copy,
       ('0x' || substr(md5('17|place|' || ident || '|' || k::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS mix_key
FROM n, LATERAL (SELECT unnest(generate_series(1, mix_copies)) AS k)
"""


def _preference_sql() -> str:
    def render(where: str) -> str:
        return f"coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) FILTER (WHERE {where}), '')"

    def spans(where: str) -> str:
        return f"coalesce(string_agg((base + length(role) + 5)::VARCHAR || ':' || (base + length(role) + 12 + length(text))::VARCHAR, ',' ORDER BY pos) FILTER (WHERE {where} AND role = 'assistant'), '')"

    return f"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
c AS (SELECT pair_id, count(*) FILTER (WHERE side) AS n_chosen, count(*) FILTER (WHERE NOT side) AS n_rejected FROM o GROUP BY 1),
e AS (SELECT a.pair_id, a.pos FROM o a JOIN o b ON a.pair_id = b.pair_id AND a.pos = b.pos AND a.side AND NOT b.side AND a.role = b.role AND a.text = b.text),
f AS (SELECT pair_id, count(*) AS run FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY pos) AS rn FROM e) WHERE pos = rn GROUP BY 1),
x AS (
  SELECT o.*, coalesce(f.run, 0) AS run,
         coalesce(sum(length(role) + length(text) + 13) FILTER (WHERE pos > coalesce(f.run, 0)) OVER (PARTITION BY o.pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM o LEFT JOIN f ON o.pair_id = f.pair_id)
SELECT x.pair_id, any_value(run) AS prompt_turns, {render('side AND pos <= run')} AS prompt,
       {render('side AND pos > run')} AS chosen, {spans('side AND pos > run')} AS chosen_mask,
       {render('NOT side AND pos > run')} AS rejected, {spans('NOT side AND pos > run')} AS rejected_mask,
       any_value(c.n_chosen) AS n_chosen, any_value(c.n_rejected) AS n_rejected
FROM x JOIN c ON x.pair_id = c.pair_id GROUP BY x.pair_id
"""


def _url_sql() -> str:
    longest_first = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1]))

    def fits(rule: str) -> str:
        host, slash, rest = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + rest}')"

    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest_first) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest_first)
    values = ", ".join(f"('{b}')" for b in URL_BLOCKED)
    listed = "EXISTS (SELECT 1 FROM l WHERE host = entry OR ends_with(host, '.' || entry) OR host || path = entry)"
    return f"""
WITH l(entry) AS (VALUES {values}),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, {rule} AS rule, {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM b
"""


def _phrase_sql() -> str:
    return f"""
WITH d AS (
  SELECT coalesce(lang, '{phrases.UNDETERMINED}') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS parts
  FROM documents),
p AS (SELECT lang, regexp_extract_all(part, '[^ \\t]+') AS ws FROM (SELECT lang, unnest(parts) AS part FROM d)),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM s, (VALUES (1), (2), (3), ({phrases.LONGEST})) AS v(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= {phrases.LEAST}),
u AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS cut FROM c),
x AS (
  SELECT u.lang, u.phrase, u.a, u.cut, h.f AS l, t.f AS r, ((2000000::HUGEINT * u.a) // (h.f::HUGEINT + t.f))::BIGINT AS score
  FROM u JOIN g h ON h.lang = u.lang AND h.phrase = array_to_string(w[1:cut], ' ')
         JOIN g t ON t.lang = u.lang AND t.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
m AS (SELECT lang, a, w, unnest(range(2, len(w))) AS k FROM c),
i AS (SELECT lang, a, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM m),
o AS (SELECT lang, array_to_string(w[j:j + k - 1], ' ') AS phrase, max(a) AS cover FROM i GROUP BY ALL),
y AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.cover IS NULL OR 100::HUGEINT * o.cover < 80::HUGEINT * b.a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y)
SELECT z.lang, rank, phrase, a, l, r, n.n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= {phrases.TOP}
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: fn for fn in (op1_mix_sources, op2_secret_scan, op3_language_id, op4_pack_sequences, op5_quality_rules, op6_media_webp, op7_substring_dedup, op8_near_duplicates, op9_preference_format, op10_url_filter, op11_ppm_score, op12_phrase_mining, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _mix_sql(), "op9_preference_format": _preference_sql(), "op10_url_filter": _url_sql(), "op12_phrase_mining": _phrase_sql()}
