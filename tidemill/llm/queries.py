"""The queries of this package and their SQL for DuckDB, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import bpe, decontaminate, embeddings, jaccard, licenses, mixing, quality, sharding, spelling, suffixes, tries, urls, wavelet
from tidemill.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def _license_sql() -> str:
    """Every place of every key phrase, by comparing lists of words; then bands as the operator numbers them."""
    rows = ",".join(
        f"({p['t']},'{p['label']}',{p['i']},{p['n']},{p['at']},{p['words']!r},{str(p['base']).lower()})" for p in licenses.key_phrases()
    )
    s, first = licenses.SLACK, sorted({p["words"][0] for p in licenses.key_phrases()})
    return rf"""
WITH phrases(t, label, i, n, begin_at, words, base) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(len(w))) AS p FROM d WHERE list_has_any(w, {first})),
places AS (SELECT r, p, t, label, i, n, begin_at, base FROM starts, phrases WHERE w[p + 1] = words[1] AND w[p + 1 : p + len(words)] = words),
b AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places WHERE base GROUP BY r),
bands AS (SELECT r, t, label, n, count(DISTINCT i) AS k FROM (SELECT *, unnest([0, {s}]) AS shift FROM places)
  GROUP BY r, t, label, n, shift, floor((p - begin_at + shift + {2 * s * 64}) / {2 * s}.0)),
m AS (SELECT r, max(k / n) AS score, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (k = n) AS labels FROM bands GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""


@_query(_license_sql())
def op1_license_scan(t: Tables) -> DataFrame:
    """Licence notices in every document."""
    return licenses.scan(t.documents)


@_query()
def op2_quality(t: Tables) -> DataFrame:
    """Quality score and verdict of every document."""
    return quality.score_documents(t.documents, t.labels)


@_query()
def op3_decontaminate(t: Tables) -> DataFrame:
    """Every document and benchmark item of which it holds a copy."""
    return decontaminate.contaminated(t.documents, t.benchmark)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query()
def op4_token_files(t: Tables) -> DataFrame:
    """Every document's place in the token files, and a checksum of its ids read back from them."""
    return wavelet.read_documents(wavelet.write_shards(t.documents, tokenizer_path()))


@_query()
def op5_embedding_duplicates(t: Tables) -> DataFrame:
    """Links, component and verdict of every vector."""
    return embeddings.near_duplicates(t.embeddings)


def _mix_sql() -> str:
    seats = """
{name}_b AS (SELECT *, CAST(CASE WHEN v > 0 THEN greatest(0, floor(q * (s - n / 2.0) + 0.5) - 1) ELSE 0 END AS BIGINT) AS sure,
  CAST(CASE WHEN v > 0 THEN floor(q * (s + n / 2.0) + 0.5) + 1 ELSE 0 END AS BIGINT) AS most FROM
  (SELECT *, count(*) FILTER (v > 0) OVER w AS n, CASE WHEN v > 0 THEN v / sum(v) OVER w ELSE 0.0 END AS q FROM {src} WINDOW w AS (PARTITION BY g))),
{name}_k AS (SELECT g, tie, row_number() OVER (PARTITION BY g ORDER BY v / (2.0 * k + 1) DESC, tie, k) AS place, open FROM
  (SELECT *, unnest(range(sure, most)) AS k FROM (SELECT *, s - sum(sure) OVER (PARTITION BY g) AS open FROM {name}_b))),
{name} AS (SELECT x.*, sure + coalesce(won, 0) AS seats FROM {name}_b x LEFT JOIN
  (SELECT g, tie, count(*) AS won FROM {name}_k WHERE place <= open GROUP BY g, tie) USING (g, tie))"""
    m, seed = mixing.MAX_REPEAT, mixing.SEED
    return rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(concat_ws(':', '{seed}', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS rows_ FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s0),
s2 AS (SELECT *, CAST([{", ".join(map(str, mixing.WEIGHTS))}][(rank - 1) % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS weight,
  CAST(source_size * {m} AS DOUBLE) AS lim FROM s1),
s3 AS (SELECT *, total - coalesce(sum(lim) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest_weight
  FROM s2 WINDOW b AS (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, lim * rest_weight <= rest * weight AS is_full FROM s3),
s5 AS (SELECT *, CASE WHEN is_full THEN lim ELSE weight * (total - coalesce(sum(lim) FILTER (is_full) OVER (), 0)) / sum(weight) FILTER (NOT is_full) OVER () END AS target,
  ceil(rows_ / {mixing.SHARD_ROWS}.0) AS shards FROM s4),
s6 AS (SELECT *, CAST(greatest(1, floor(total / greatest({mixing.BLOCKS}, sum(shards) OVER () * {mixing.BLOCKS_PER_SHARD}))) AS BIGINT) AS block FROM s5),
s7 AS (SELECT *, 0 AS g, rank AS tie, target AS v, CAST(round(total / block) AS BIGINT) AS s FROM s6),
{seats.format(name="source_seats", src="s7").strip()},
placed AS (SELECT d.*, rank, source_size, target, block, seats AS source_seats, CAST('0x' || substr(key, 1, 8) AS BIGINT) % CAST(shards AS BIGINT) AS shard
  FROM sized d JOIN source_seats t ON d.source IS NOT DISTINCT FROM t.source),
c0 AS (SELECT rank AS g, shard AS tie, block, source_seats AS s, CAST(sum(size) AS BIGINT) AS c, CAST(sum(size) AS DOUBLE) AS v FROM placed GROUP BY rank, shard, block, source_seats),
{seats.format(name="cell_seats", src="c0").strip()},
c1 AS (SELECT g AS rank, tie AS shard, c, CAST(greatest(1, round(c / block)) AS BIGINT) AS m, seats FROM cell_seats),
c2 AS (SELECT *, least(seats, {m} * m) AS k, CAST('0x' || substr(md5(concat_ws(':', '{seed}', rank, shard)), 1, 8) AS BIGINT) % m AS o FROM c1),
c3 AS (SELECT rank, shard, k, k // m AS rounds, floor(o * c / m) AS a, floor(least(o + k % m, m) * c / m) AS z, floor(greatest(o + k % m - m, 0) * c / m) AS wrap FROM c2),
lines AS (SELECT *, sum(size) OVER (PARTITION BY rank, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS e FROM placed)
SELECT doc_id, size, source_size, target,
  CAST(rounds * size + greatest(0, least(e, z) - greatest(e - size, a)) + greatest(0, least(e, wrap) - greatest(e - size, 0)) AS BIGINT) AS taken,
  CAST(rank AS INTEGER) AS source_rank, shard, k AS shard_quota
FROM lines JOIN c3 USING (rank, shard)"""


@_query(_mix_sql())
def op6_mix_sources(t: Tables) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix(t.documents)


@_query()
def op7_repeated_strings(t: Tables) -> DataFrame:
    """Every document without the strings that start in an earlier one."""
    return suffixes.without_repeats(t.documents).drop("kept")


@_query()
def op8_virtual_slots(t: Tables) -> DataFrame:
    """Every document's place in one of eight shards, by the map stored for these documents."""
    return sharding.shard(t.documents, 8, store=sharding.store_for(t.spark, t.folder))[0]


@_query()
def op9_jaccard_groups(t: Tables) -> DataFrame:
    """Group of every document under shingle similarity."""
    return jaccard.similar_groups(t.documents)


def _urls_sql() -> str:
    rules = sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda r: f"((host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}'))"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in rules) + " END"
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    # Terms and their strength in the host and behind it; a joined one may touch others at one end.
    alone, front, back = "(^|[^a-z0-9]){}([^a-z0-9]|$)", "(^|[^a-z0-9]){}", "{}([^a-z0-9]|$)"
    terms = []
    for term in sorted({*urls.HOST_TERMS, *urls.PATH_TERMS}):
        h, p = urls.HOST_TERMS.get(term, 0), urls.PATH_TERMS.get(term, 0)
        in_host = f"{front}|{back}".format(term, term) if term in urls.JOINED else alone.format(term)
        terms.append(f"('{term}', {h}, {p}, '{in_host}', '{alone.format(term)}')")
    return f"""
WITH r AS (SELECT row_number() OVER () AS k, page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT k, page_id, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
  {lower("CASE WHEN strpos(url, '://') > 0 THEN substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) ELSE url END")} AS behind FROM r),
terms(term, h, p, in_host, behind_host) AS (VALUES {", ".join(terms)}),
w AS (SELECT k, greatest(CASE WHEN h > 0 AND regexp_matches(host, in_host) THEN h ELSE 0 END, CASE WHEN terms.p > 0 AND regexp_matches(behind, behind_host) THEN terms.p ELSE 0 END) AS weight
  FROM p, terms WHERE contains(host, term) OR contains(behind, term)),
s AS (SELECT k, CAST(count(*) FILTER (weight >= {urls.REJECT_AT}) AS INTEGER) AS strict_hits, CAST(count(*) FILTER (weight > 0 AND weight < {urls.REJECT_AT}) AS INTEGER) AS soft_hits,
  CAST(sum(weight) AS INTEGER) AS weight FROM w GROUP BY k),
h AS (SELECT p.*, coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits, coalesce(weight, 0) AS weight FROM p LEFT JOIN s USING (k))
SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule,
  coalesce({case(lambda r: r[0])}, CASE WHEN weight >= {urls.REJECT_AT} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits, weight FROM h"""


@_query(_urls_sql())
def op10_url_filter(t: Tables) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return urls.judge(t.pages)


#: The table of the reflected CRC-32 polynomial, for ``_crc32``.
_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
  lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS tab)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; ``tab`` must be in scope."""
    code = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({code}, lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS INTEGER) + 1]), 4294967295), 4294967295)"


def _spelling_sql() -> str:
    low = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[{spelling.LETTERS}]{{{spelling.MIN_LETTERS},}}')) AS run FROM documents),
low AS (SELECT id, {low} AS w, count(*) AS c FROM runs GROUP BY ALL),
checked AS (SELECT w, c, {_crc32("id || ':' || w")} AS h FROM low, crc_table),
seen AS (SELECT CASE WHEN h % {spelling.NOISE} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM checked),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM seen WHERE length(word) >= {spelling.MIN_LETTERS} GROUP BY word HAVING sum(c) >= {spelling.MIN_COUNT}),
dels AS (SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM dels a JOIN dels b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM dels d JOIN words w ON d.rest = w.word
  UNION SELECT w.word, w.n, d.word, d.n FROM dels d JOIN words w ON d.rest = w.word),
best AS (SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM pairs),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {spelling.RATIO} * w.n THEN other END AS form,
  CASE WHEN other_n >= {spelling.RATIO} * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND k = 1),
chain AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ends e ON e.word = f.word"""


@_query(_spelling_sql())
def op11_spelling_variants(t: Tables) -> DataFrame:
    """Every word with the frequent word it is a variant of."""
    return spelling.variants(t.documents)


@_query()
def op12_bpe_round_trip(t: Tables) -> DataFrame:
    """Checksums of every document's ids and of the text they decode to."""
    import public_tokenizers

    return bpe.round_trips(t.documents, public_tokenizers.path("word_bpe_49k.json"))


def _trie_sql() -> str:
    heads = tries.HEADS
    return f"""
WITH {_CRC_TABLE},
turns AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) AS size,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - (conv_id % {tries.FAMILY} + {tries.FAMILY}) % {tries.FAMILY} AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % {heads} AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
parts AS (SELECT c.conv_id, 0 AS own, p, k, size FROM convs c JOIN turns t ON t.conv_id = c.base AND t.p < c.h
  UNION ALL SELECT c.conv_id, 1, p, k, size FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p >= c.h),
beginnings AS (SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(k, '') OVER w) AS path, size FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY own, p)),
members AS (SELECT conv_id, depth, path, lag(path, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS above, size FROM beginnings
  UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM convs),
sized AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS whole FROM members),
node AS (SELECT depth, path, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = whole), '')) AS ends_sha256 FROM sized GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN kids USING (depth, path)),
up AS (SELECT a.depth, a.path, x.depth AS d2, x.path AS p2 FROM sized a JOIN sized x ON x.conv_id = a.conv_id AND x.depth >= a.depth GROUP BY ALL),
sums AS (SELECT u.depth, u.path, CAST(count(*) FILTER (f.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((f.n_convs - 1) * f.size) AS BIGINT) AS saved_tokens
  FROM up u JOIN full_ f ON f.depth = u.d2 AND f.path = u.p2 GROUP BY ALL)
SELECT f.conv_id, f.depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN sums s ON s.depth = f.depth AND s.path = f.path LEFT JOIN node a ON a.depth = f.depth - 1 AND a.path = f.above"""


@_query(_trie_sql())
def op13_conversation_trie(t: Tables) -> DataFrame:
    """Every shared beginning of the rebuilt conversations."""
    return tries.nodes(tries.shared_heads(t.conversations))
