"""The engine's queries by name, and their equivalents in DuckDB SQL.

The tables hold no sequences, so documents stand for reads: their letters map to ACGT (`document_reads`). Labelings that the
metrics compare are columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readpool.config import ClusterConfig, budgets, substring_sizes
from readpool.functions.sequences import qgrams, substring_key, tiebreak, within_edits
from readpool.operators import blocking, metrics, verify
from readpool.operators import representatives as reps_
from readpool.operators.sketch import sketches, with_grams
from readpool.plans import pipeline
from readpool.plans.components import connected_components, written
from readpool.sources import blocks
from readpool.sources.tables import document_reads, letters_of, table

CONFIG = ClusterConfig()
ANCHORS = CONFIG.anchors(4, 2, 4, "query")
SUBSTRING = 12

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- what the SQL side shares ----------------------------------------------------------------------------


def values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def letters_sql(text: str) -> str:
    return f"translate(regexp_replace(lower({text}), '[^a-z]+', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '{''.join('ACGT'[i % 4] for i in range(26))}')"


CODE = " + ".join(f"(instr('ACGT', substring(seq, pos + {p + 1}, 1)) - 1) * {4**p}" for p in range(CONFIG.q))
BITS = CONFIG.code_bits
MASK = (1 << BITS) - 1
READS = f"reads AS (SELECT * FROM (SELECT doc_id AS read_id, {letters_sql('text')} AS seq FROM documents) WHERE length(seq) >= {CONFIG.q} AND read_id IS NOT NULL)"
CODES = f"codes AS (SELECT read_id, CAST(pos AS INTEGER) AS pos, CAST({CODE} AS INTEGER) AS code FROM (SELECT read_id, seq, unnest(range(0, length(seq) - {CONFIG.q - 1})) AS pos FROM reads))"
GRAMS = "grams AS (SELECT r.read_id, any_value(r.seq) AS seq, list(code ORDER BY pos) AS g FROM reads r JOIN codes USING (read_id) GROUP BY r.read_id)"
SIGS = f"""perms(p, a, b, c) AS (VALUES {values((p, *x) for p, x in enumerate(CONFIG.permutations()))}),
vals AS (SELECT read_id, p, min(xor(x, x >> {BITS // 2 - 1})) AS val FROM (
  SELECT read_id, p, (xor(x, x >> {BITS // 2}) * c) & {MASK} AS x FROM (
    SELECT read_id, p, c, (a * code + b) & {MASK} AS x FROM (SELECT DISTINCT read_id, code FROM codes) CROSS JOIN perms)) GROUP BY read_id, p),
sigs AS (SELECT read_id, list(val ORDER BY p) AS sig FROM vals GROUP BY read_id)"""


def bands_sql(bands, first: int = 0) -> str:
    return f"""bands(round, i0, i1, i2) AS (VALUES {values((first + r, *x) for r, x in enumerate(bands))}),
keys AS (SELECT round, read_id, CAST(sig[i0 + 1] AS BIGINT) + CAST(sig[i1 + 1] AS BIGINT) * {1 << BITS} + CAST(sig[i2 + 1] AS BIGINT) * {1 << 2 * BITS} AS key FROM sigs CROSS JOIN bands)"""


PAIRS = f"""pairs AS (SELECT round, least(read_id, other) AS a, greatest(read_id, other) AS b FROM (
  SELECT round, read_id, lag(read_id) OVER (PARTITION BY round, key ORDER BY md5('{CONFIG.seed}:' || round || ':' || read_id), read_id) AS other FROM keys)
  WHERE other IS NOT NULL AND other <> read_id),
counted AS (SELECT a, b, count(*) AS mult FROM pairs GROUP BY a, b)"""
DICE = "2.0 * len(list_distinct(list_intersect(x.g, y.g))) / (len(x.g) + len(y.g))"


def verified_sql(high: float, low: float, source: str = "counted") -> str:
    return f"""sims AS (SELECT c.*, {DICE} AS sd, x.seq AS sx, y.seq AS sy FROM {source} c JOIN grams x ON x.read_id = c.a JOIN grams y ON y.read_id = c.b),
near AS (SELECT a, b FROM sims WHERE sd >= {low} AND sd < {high} AND abs(length(sx) - length(sy)) <= {CONFIG.edit_limit}),
edits AS (SELECT n.a, n.b, levenshtein(x.seq, y.seq) AS ed FROM near n JOIN reads x ON x.read_id = n.a JOIN reads y ON y.read_id = n.b),
verified AS (SELECT s.a, s.b, mult, sd, (sd >= {high} OR coalesce(ed, {CONFIG.edit_limit} + 1) <= {CONFIG.edit_limit}) AS accepted FROM sims s LEFT JOIN edits e ON e.a = s.a AND e.b = s.b)"""


# Least node that each node reaches: labels spread until nothing changes.
def components_sql(edges: str, nodes: str) -> str:
    return f"""both_ways AS (SELECT a AS u, b AS v FROM {edges} UNION SELECT b, a FROM {edges}),
reach(node, other) AS (SELECT node, node FROM ({nodes}) UNION SELECT reach.node, both_ways.v FROM reach JOIN both_ways ON reach.other = both_ways.u),
comps AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


UPTO_PAIRS = f"{READS}, {CODES}, {GRAMS}, {SIGS}, {bands_sql(CONFIG.bands())}, {PAIRS}"
UPTO_VERIFIED = f"{UPTO_PAIRS}, {verified_sql(CONFIG.chunk_high, CONFIG.chunk_low)}"
EDGES = "edges AS (SELECT a, b, mult FROM verified WHERE accepted)"
UPTO_CLUSTERS = f"{UPTO_VERIFIED}, {EDGES}, {components_sql('edges', 'SELECT read_id AS node FROM reads')}, clusters AS (SELECT node AS read_id, component AS cluster FROM comps)"
SCORES = "scores AS (SELECT read_id, CAST(sum(mult) AS BIGINT) AS score FROM (SELECT a AS read_id, mult FROM edges UNION ALL SELECT b, mult FROM edges) GROUP BY read_id)"


def reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_reads(spark, sf_dir, q=CONFIG.q)


def paired(sketched: DataFrame) -> DataFrame:
    keyed = blocking.band_keys(sketched.select("read_id", "sig"), CONFIG.bands(), BITS)
    return blocking.adjacent_pairs(keyed, ["round", "key"], CONFIG.seed)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(sketches(reads_of(spark, sf_dir), CONFIG))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pipeline.prepare(reads_of(spark, sf_dir), CONFIG)
    return verify.verified(verify.counted(paired(p.sketched)), p.sketched, p.reads, CONFIG.chunk_high, CONFIG.chunk_low, CONFIG.edit_limit)


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).filter("accepted").select("a", "b", "mult")


# --- reads and sketches ----------------------------------------------------------------------------------


@query(f"WITH {READS} SELECT read_id, seq FROM reads")
def reads_projected(spark, sf_dir):
    return reads_of(spark, sf_dir)


@query(f"WITH {READS} SELECT row_number() OVER (ORDER BY md5('7:' || read_id), read_id) - 1 AS read_id, seq FROM reads")
def shuffled_reads(spark, sf_dir):
    return blocks.shuffled_ids(reads_of(spark, sf_dir), CONFIG.seed)


@query(f"WITH {READS}, {CODES} SELECT read_id, pos, code FROM codes")
def qgram_codes(spark, sf_dir):
    return reads_of(spark, sf_dir).select("read_id", F.posexplode(qgrams("seq", CONFIG.q)).alias("pos", "code"))


@query(f"WITH {READS}, {CODES} SELECT read_id, count(*) AS n_bag, count(DISTINCT code) AS n_set FROM codes GROUP BY read_id")
def qgram_set_sizes(spark, sf_dir):
    grams = with_grams(reads_of(spark, sf_dir), CONFIG)
    return grams.select("read_id", F.size("grams").cast("bigint").alias("n_bag"), F.size(F.array_distinct("grams")).cast("bigint").alias("n_set"))


@query(f"WITH {READS}, {CODES}, {SIGS} SELECT read_id, CAST(p AS INTEGER) AS p, CAST(val AS INTEGER) AS val FROM vals")
def minhash_signature(spark, sf_dir):
    return sketches(reads_of(spark, sf_dir), CONFIG).select("read_id", F.posexplode("sig").alias("p", "val"))


@query(f"WITH {READS}, {CODES}, {SIGS}, {bands_sql(CONFIG.bands())} SELECT CAST(round AS INTEGER) AS round, read_id, key FROM keys")
def band_keys(spark, sf_dir):
    return blocking.band_keys(sketches(reads_of(spark, sf_dir), CONFIG), CONFIG.bands(), BITS).select("round", "read_id", "key")


# --- candidates and verification -------------------------------------------------------------------------


@query(f"WITH {UPTO_PAIRS} SELECT CAST(round AS INTEGER) AS round, a, b FROM pairs")
def band_candidates(spark, sf_dir):
    return candidates(spark, sf_dir)


@query(f"WITH {UPTO_PAIRS} SELECT a, b, round({DICE}, 9) AS sd FROM counted c JOIN grams x ON x.read_id = c.a JOIN grams y ON y.read_id = c.b")
def dice_pairs(spark, sf_dir):
    sketched = pipeline.prepare(reads_of(spark, sf_dir), CONFIG).sketched
    return verify.compared(verify.counted(paired(sketched)), sketched).select("a", "b", F.round("sd", 9).alias("sd"))


@query(
    f"""WITH {UPTO_PAIRS}, alike AS (SELECT a, b, x.seq AS sx, y.seq AS sy FROM counted c JOIN reads x ON x.read_id = c.a JOIN reads y ON y.read_id = c.b WHERE abs(length(x.seq) - length(y.seq)) <= {CONFIG.edit_limit})
SELECT a, b, edits FROM (SELECT a, b, CAST(0 AS BIGINT) AS edits FROM alike WHERE sx = sy UNION ALL SELECT a, b, levenshtein(sx, sy) AS edits FROM alike WHERE sx <> sy) WHERE edits <= {CONFIG.edit_limit}"""
)
def edit_distance_pairs(spark, sf_dir):
    p = pipeline.prepare(reads_of(spark, sf_dir), CONFIG)
    reads = p.reads
    alike = F.abs(F.col("n_a") - F.col("n_b")) <= CONFIG.edit_limit
    pairs = verify.compared(verify.counted(paired(p.sketched)), p.sketched).filter(alike).select("a", "b")
    both = pairs.join(reads.withColumnsRenamed({"read_id": "a", "seq": "sa"}), "a").join(reads.withColumnsRenamed({"read_id": "b", "seq": "sb"}), "b")
    return both.filter(within_edits("sa", "sb", CONFIG.edit_limit)).select("a", "b", F.levenshtein("sa", "sb", CONFIG.edit_limit).cast("bigint").alias("edits"))


@query(f"WITH {UPTO_VERIFIED} SELECT a, b, mult, round(sd, 9) AS sd, accepted FROM verified")
def verified_pairs(spark, sf_dir):
    return checked(spark, sf_dir).select("a", "b", "mult", F.round("sd", 9).alias("sd"), "accepted")


# --- substring chunks ------------------------------------------------------------------------------------


def anchored_sql(anchor: str) -> str:
    return f"substring(seq, greatest(instr(seq, '{anchor}'), 1), {SUBSTRING})"


KEYS_SQL = " UNION ALL ".join(f"SELECT read_id, {r} AS round, least({anchored_sql(x)}, {anchored_sql(y)}) AS key1, greatest({anchored_sql(x)}, {anchored_sql(y)}) AS key2 FROM reads" for r, (x, y) in enumerate(ANCHORS))
CHUNK_EDGES = f"skeys AS ({KEYS_SQL}), chunk_edges AS (SELECT DISTINCT min(read_id) OVER (PARTITION BY key1, key2) AS a, read_id AS b FROM skeys WHERE round = 0)"
CHUNKS = f"{READS}, {CHUNK_EDGES}, {components_sql('(SELECT a, b FROM chunk_edges WHERE a <> b)', 'SELECT read_id AS node FROM reads')}, chunks AS (SELECT node AS read_id, component AS chunk_id FROM comps)"


@query(f"WITH {READS} SELECT read_id, CAST(round AS INTEGER) AS round, key1, key2 FROM ({KEYS_SQL})")
def common_substring_keys(spark, sf_dir):
    reads = reads_of(spark, sf_dir)
    rounds = F.array(*(F.struct(F.lit(r).alias("round"), substring_key("seq", list(x), SUBSTRING).alias("key")) for r, x in enumerate(ANCHORS)))
    return reads.select("read_id", F.explode(rounds).alias("k")).select("read_id", "k.round", F.col("k.key")[0].alias("key1"), F.col("k.key")[1].alias("key2"))


def one_round_chunks(spark, sf_dir):
    reads = reads_of(spark, sf_dir)
    edges = blocking.substring_edges(reads.select(F.col("read_id").alias("chunk_id"), "seq", F.lit(0).alias("turn")), [ANCHORS[0]], SUBSTRING)
    return reps_.merged(reads, edges).withColumnRenamed("cluster", "chunk_id")


@query(f"WITH RECURSIVE {CHUNKS} SELECT read_id, chunk_id FROM chunks")
def substring_chunks(spark, sf_dir):
    return one_round_chunks(spark, sf_dir)


@query(f"WITH RECURSIVE {CHUNKS}, sizes AS (SELECT chunk_id, count(*) AS n FROM chunks GROUP BY chunk_id) SELECT chunk_id, n FROM sizes WHERE n >= 0.5 * (SELECT avg(n) FROM sizes)")
def chunk_size_filter(spark, sf_dir):
    return reps_.reasonable(written(one_round_chunks(spark, sf_dir)), CONFIG.reasonable_chunk)


@query(
    f"""WITH RECURSIVE {CHUNKS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY md5('7:' || read_id), read_id) AS rk FROM chunks)
SELECT read_id, chunk_id FROM ranked WHERE rk <= {CONFIG.reps_per_chunk}"""
)
def chunk_samples(spark, sf_dir):
    return reps_.sampled(one_round_chunks(spark, sf_dir), ["chunk_id"], CONFIG.reps_per_chunk, tiebreak(CONFIG.seed, "read_id"))


# --- clusters --------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {UPTO_CLUSTERS} SELECT node, component FROM comps WHERE node IN (SELECT a FROM edges UNION SELECT b FROM edges)")
def connected_components_of_edges(spark, sf_dir):
    return connected_components(edges_of(spark, sf_dir))


@query(f"WITH RECURSIVE {UPTO_CLUSTERS} SELECT read_id, cluster FROM clusters")
def banded_clusters(spark, sf_dir):
    return reps_.merged(reads_of(spark, sf_dir), edges_of(spark, sf_dir))


@query(f"WITH {UPTO_VERIFIED}, {EDGES}, {SCORES} SELECT read_id, score FROM scores")
def pair_scores(spark, sf_dir):
    return reps_.scores(edges_of(spark, sf_dir))


REPS = f"""{SCORES}, reps AS (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY coalesce(score, 0) DESC, read_id) AS rk, read_id, coalesce(score, 0) AS score
  FROM clusters LEFT JOIN scores USING (read_id))"""


def clusters_and_scores(spark, sf_dir):
    edges = written(edges_of(spark, sf_dir))
    return written(reps_.merged(reads_of(spark, sf_dir), edges)), reps_.scores(edges)


@query(f"WITH RECURSIVE {UPTO_CLUSTERS}, {REPS} SELECT cluster, CAST(rk AS INTEGER) AS rk, read_id, score FROM reps WHERE rk <= {CONFIG.reps_per_cluster}")
def cluster_representatives(spark, sf_dir):
    return reps_.representatives(*clusters_and_scores(spark, sf_dir), CONFIG.reps_per_cluster)


@query(
    f"""WITH RECURSIVE {UPTO_CLUSTERS}, {REPS}, sizes AS (SELECT cluster, count(*) AS n FROM clusters GROUP BY cluster)
SELECT read_id, cluster FROM clusters JOIN sizes USING (cluster) WHERE n = 1
UNION ALL SELECT read_id, cluster FROM reps JOIN sizes USING (cluster) WHERE n > 1 AND rk = 2"""
)
def focus_rows(spark, sf_dir):
    clusters, scored = clusters_and_scores(spark, sf_dir)
    return reps_.focus(clusters, reps_.representatives(clusters, scored, CONFIG.reps_per_cluster), 1)


@query(f"WITH RECURSIVE {UPTO_CLUSTERS}, sizes AS (SELECT count(*) AS n FROM clusters GROUP BY cluster) SELECT count(*) AS n_clusters, count(*) FILTER (n = 1) AS n_singles FROM sizes")
def cluster_counts(spark, sf_dir):
    return reps_.cluster_counts(reps_.merged(reads_of(spark, sf_dir), edges_of(spark, sf_dir)))


# --- blocks ----------------------------------------------------------------------------------------------

# Conversations as blocks: the first turn is the strand, the others are its copies.
TURNS = f"""turns AS (SELECT conv_id, turn, {letters_sql('text')} AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations),
lines AS (SELECT conv_id, 3 * k AS line_no, seq AS value FROM turns UNION ALL SELECT conv_id, 4, '{blocks.SEPARATOR}' FROM turns WHERE k = 1)"""


def dialogue_lines(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    seq = letters_of(F.col("text"))
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    turns = turns.select("conv_id", seq.alias("value"), k.alias("k"))
    marks = turns.filter("k = 1").select("conv_id", F.lit(4).cast("bigint").alias("line_no"), F.lit(blocks.SEPARATOR).alias("value"))
    lines = turns.select("conv_id", (3 * F.col("k")).cast("bigint").alias("line_no"), "value").unionByName(marks)
    return lines.filter("value <> ''").select(F.format_string("%08d", "conv_id").alias("file"), "line_no", "value")


@query(
    f"""WITH {TURNS}, heads AS (SELECT conv_id, seq AS strand FROM turns WHERE k = 1 AND seq <> ''),
copies AS (SELECT t.conv_id, t.k, t.seq FROM turns t JOIN heads USING (conv_id) WHERE k > 1 AND length(seq) >= {CONFIG.q})
SELECT row_number() OVER (ORDER BY c.conv_id, k) - 1 AS read_id, c.seq, h.strand FROM copies c JOIN heads h USING (conv_id)"""
)
def parse_blocks(spark, sf_dir):
    pool = blocks.parse(dialogue_lines(spark, sf_dir), CONFIG.q)
    return pool.reads.join(pool.originals, "cluster_id").select("read_id", "seq", "strand")


LABELS = """truth AS (SELECT doc_id AS read_id, lang || '/' || source AS label FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
groups AS (SELECT doc_id AS read_id, CASE WHEN doc_id % 7 = 0 THEN source WHEN doc_id % 3 = 0 THEN lang || '/' || source || '/x' ELSE lang || '/' || source END AS name FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
pred AS (SELECT read_id, min(read_id) OVER (PARTITION BY name) AS cluster FROM groups)"""


def labelings(spark, sf_dir):
    """(pred, truth): two labelings of documents."""
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    label = F.concat_ws("/", "lang", "source")
    name = F.when(F.col("doc_id") % 7 == 0, F.col("source")).when(F.col("doc_id") % 3 == 0, F.concat(label, F.lit("/x"))).otherwise(label)
    rows = docs.select(F.col("doc_id").alias("read_id"), label.alias("label"), name.alias("name"))
    least = rows.groupBy("name").agg(F.min("read_id").alias("cluster"))
    return rows.join(least, "name").select("read_id", "cluster"), rows.select("read_id", "label")


@query(
    f"""WITH {LABELS}, votes AS (SELECT cluster, label, count(*) AS n, min(read_id) AS first FROM pred JOIN truth USING (read_id) GROUP BY cluster, label)
SELECT cluster, label AS strand_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first) AS rk FROM votes) WHERE rk = 1"""
)
def majority_strand(spark, sf_dir):
    pred, truth = labelings(spark, sf_dir)
    return blocks.majority_strand(pred.join(truth.withColumnRenamed("label", "strand_id"), "read_id"))


EXPORT = f"""{READS}, {LABELS}, members AS (SELECT cluster, read_id, label, seq FROM pred JOIN truth USING (read_id) JOIN reads USING (read_id)),
votes AS (SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, min(read_id)) AS rk FROM members GROUP BY cluster, label),
strands AS (SELECT label, md5(label) AS strand FROM truth GROUP BY label)"""


@query(
    f"""WITH {EXPORT} SELECT m.cluster, any_value(s.strand) || chr(10) || '{blocks.SEPARATOR}' || chr(10) || string_agg(m.seq, chr(10) ORDER BY read_id) || chr(10) || chr(10) AS block
FROM members m JOIN votes v ON v.cluster = m.cluster AND v.rk = 1 JOIN strands s ON s.label = v.label GROUP BY m.cluster"""
)
def export_blocks(spark, sf_dir):
    pred, truth = labelings(spark, sf_dir)
    members = pred.join(truth.withColumnRenamed("label", "strand_id"), "read_id").join(reads_of(spark, sf_dir), "read_id")
    originals = truth.select(F.col("label").alias("cluster_id")).distinct().withColumn("strand", F.md5(F.col("cluster_id").cast("binary")))
    return blocks.blocks(members, originals)


@query(f"WITH {READS}, {LABELS} SELECT seq, coalesce(min(t.label), '{blocks.UNKNOWN}') AS strand_id FROM reads LEFT JOIN truth t USING (read_id) GROUP BY seq")
def read_lookup(spark, sf_dir):
    """The strand of every read by its text; of equal texts the least label."""
    reads = reads_of(spark, sf_dir)
    pool = reads.join(labelings(spark, sf_dir)[1].withColumnRenamed("label", "strand_id"), "read_id")
    return blocks.lookup(reads.select("seq").distinct(), pool)


@query(f"WITH {READS} SELECT CAST(row_number() OVER (ORDER BY seq, read_id) - 1 AS BIGINT) AS place, read_id FROM reads")
def reads_by_text(spark, sf_dir):
    """All reads in the order of their text."""
    return blocks.in_order(reads_of(spark, sf_dir), ["seq", "read_id"], "place").select("place", "read_id")


# --- metrics ---------------------------------------------------------------------------------------------

TABLE = f"{LABELS}, cells AS (SELECT cluster, label, count(*) AS n, min(read_id) AS first FROM pred JOIN truth USING (read_id) GROUP BY cluster, label)"
POSITIONS = f"""{LABELS}, cells AS (SELECT cluster, label, count(*) AS n FROM (SELECT cluster, row_number() OVER (ORDER BY cluster, read_id) AS i FROM pred) JOIN
  (SELECT label, row_number() OVER (ORDER BY label, read_id) AS i FROM truth) USING (i) GROUP BY cluster, label)"""
JUDGED = """ts AS (SELECT label, sum(n) AS true_size FROM cells GROUP BY label),
judged AS (SELECT c.cluster, CAST(c.size AS BIGINT) AS size, c.hits, CAST(ts.true_size AS BIGINT) AS true_size FROM
  (SELECT cluster, sum(n) AS size, arg_min(label, first) AS label, arg_min(n, first) AS hits FROM cells GROUP BY cluster) c JOIN ts USING (label)),
gammas(gamma) AS (VALUES (CAST(0.6 AS DOUBLE)), (0.7), (0.8), (0.9), (0.95), (0.99), (1.0))"""
MARGINS = """m AS (SELECT
  (SELECT sum(n) FROM cells) AS n,
  (SELECT sum(n * ln(n)) FROM cells) AS hc, (SELECT sum(n * ln(n)) FROM (SELECT sum(n) AS n FROM cells GROUP BY cluster)) AS hp, (SELECT sum(n * ln(n)) FROM (SELECT sum(n) AS n FROM cells GROUP BY label)) AS ht,
  (SELECT sum(n * (n - 1) / 2) FROM cells) AS pc, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY cluster)) AS pp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY label)) AS pt)"""
NMI = "SELECT round((2 * ln(n) - hp / n - ht / n - (ln(n) - hc / n)) / ((2 * ln(n) - hp / n - ht / n) / 2), 9) AS nmi FROM m"
ARI = "SELECT round((pc - pp * pt / (n * (n - 1) / 2)) / ((pp + pt) / 2 - pp * pt / (n * (n - 1) / 2)), 9) AS ari FROM m"
PURITY = "SELECT round(sum(best) / sum(size), 9) AS purity FROM (SELECT max(n) AS best, sum(n) AS size FROM cells GROUP BY cluster)"


def cells(spark, sf_dir):
    return metrics.contingency(*labelings(spark, sf_dir))


def places(spark, sf_dir):
    return metrics.positional(*labelings(spark, sf_dir))


@query(f"WITH {TABLE} SELECT cluster, label, n FROM cells")
def contingency_table(spark, sf_dir):
    return cells(spark, sf_dir).drop("first")


@query(f"WITH {TABLE}, {JUDGED} SELECT gamma, round(avg(CASE WHEN size <= true_size AND hits = size AND hits >= gamma * true_size THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM judged CROSS JOIN gammas GROUP BY gamma")
def accuracy_gamma(spark, sf_dir):
    return metrics.accuracy(cells(spark, sf_dir))


@query(
    f"""WITH {TABLE}, {JUDGED} SELECT gamma, count(*) FILTER (size > true_size) AS too_big, count(*) FILTER (size <= true_size AND hits < size) AS impure,
count(*) FILTER (size <= true_size AND hits = size AND hits < gamma * true_size) AS not_big_enough FROM judged CROSS JOIN gammas GROUP BY gamma"""
)
def accuracy_diagnostics(spark, sf_dir):
    return metrics.diagnostics(cells(spark, sf_dir))


@query(
    f"""WITH {TABLE}, {JUDGED}, x AS (SELECT sum(size) AS n, sum(size - hits) AS fp FROM judged), y AS (SELECT sum(size - kept) AS fn FROM (SELECT sum(n) AS size, arg_min(n, first) AS kept FROM cells GROUP BY label))
SELECT CAST(n AS BIGINT) AS n, CAST(fp AS BIGINT) AS fp, CAST(n - fp AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, CAST(n - fn AS BIGINT) AS tp, round((n - fn) / (n - fn + fn + fp), 9) AS ts FROM x CROSS JOIN y"""
)
def fp_fn_ts(spark, sf_dir):
    return metrics.errors(cells(spark, sf_dir))


def _metric(name: str, made, source, sql: str) -> None:
    QUERIES[name], ORACLES[name] = (lambda spark, sf_dir: made(source(spark, sf_dir))), sql


for _name, _made, _sql in (("nmi", metrics.nmi, NMI), ("ari", metrics.ari, ARI), ("purity", metrics.purity, PURITY)):
    _metric(_name, _made, cells, f"WITH {TABLE}, {MARGINS} {_sql}")
    _metric(f"{_name}_positional", _made, places, f"WITH {POSITIONS}, {MARGINS} {_sql}")


@query(
    f"""WITH {LABELS} SELECT read_id, CAST(dense_rank() OVER (ORDER BY label) AS BIGINT) - 1 AS label FROM truth"""
)
def dense_labels(spark, sf_dir):
    """Consecutive numbers of labels, in their order; only distinct labels are ranked."""
    truth = labelings(spark, sf_dir)[1]
    number = truth.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")).cast("bigint") - 1).alias("k"))
    return truth.join(number, "label").select("read_id", F.col("k").alias("label"))


@query(f"WITH {READS} SELECT seq, count(*) AS n, min(read_id) AS first FROM reads GROUP BY seq")
def distinct_reads(spark, sf_dir):
    return reads_of(spark, sf_dir).groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("read_id").alias("first"))


@query(f"WITH {READS} SELECT read_id, md5('{CONFIG.seed}:' || read_id) AS mark FROM reads")
def seeded_order(spark, sf_dir):
    return reads_of(spark, sf_dir).select("read_id", tiebreak(CONFIG.seed, "read_id").alias("mark"))


@query(
    f"""WITH {READS}, s AS (SELECT count(*) AS n, arg_min(length(seq), read_id) AS l FROM reads)
SELECT n, CAST(least(greatest(ceil(10000000 / n), 4), 1000) AS INTEGER) AS bad_rounds, CAST(ceil(pow(n, 0.2)) AS INTEGER) AS work, CAST(greatest(ceil(pow(n, 1 / 2.2)), 300) AS INTEGER) AS rounds,
CAST(greatest(ceil(ln(l) / ln(4)) - 1, 1) AS INTEGER) AS anchor_width FROM s"""
)
def parameters(spark, sf_dir):
    reads = reads_of(spark, sf_dir)
    row = reads.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("read_id", F.length("seq").alias("l")))["l"].alias("l")).first()
    limits = budgets(row["n"], CONFIG)
    width, _ = substring_sizes(row["l"], row["n"], 1)
    return spark.createDataFrame([(row["n"], limits["bad_rounds"], limits["work"], limits["rounds"], width)], "n bigint, bad_rounds int, work int, rounds int, anchor_width int")


# --- whole stages ----------------------------------------------------------------------------------------


@query()
def stage1_chunks(spark, sf_dir):
    return pipeline.chunk_partition(pipeline.prepare(reads_of(spark, sf_dir), CONFIG), CONFIG)


STAGE2_CHUNKS = f"{CHUNKS}, sizes AS (SELECT chunk_id, count(*) AS n FROM chunks GROUP BY chunk_id), eligible AS (SELECT chunk_id FROM sizes WHERE n > 1 AND n >= 0.5 * (SELECT avg(n) FROM sizes))"
STAGE2_PAIRS = f"""pairs AS (SELECT round, least(read_id, other) AS a, greatest(read_id, other) AS b FROM (
  SELECT round, read_id, lag(read_id) OVER (PARTITION BY round, chunk_id, key ORDER BY md5('{CONFIG.seed}:' || round || ':' || read_id), read_id) AS other FROM keys JOIN chunks USING (read_id) JOIN eligible USING (chunk_id))
  WHERE other IS NOT NULL AND other <> read_id), counted AS (SELECT a, b, count(*) AS mult FROM pairs GROUP BY a, b)"""


@query(
    f"""WITH RECURSIVE {STAGE2_CHUNKS}, {CODES}, {GRAMS}, {SIGS}, {bands_sql(CONFIG.bands())}, {STAGE2_PAIRS}, {verified_sql(CONFIG.chunk_high, CONFIG.chunk_low)}, {EDGES},
both2 AS (SELECT a AS u, b AS v FROM edges UNION SELECT b, a FROM edges),
reach2(node, other) AS (SELECT read_id, read_id FROM reads UNION SELECT reach2.node, both2.v FROM reach2 JOIN both2 ON reach2.other = both2.u)
SELECT node AS read_id, min(other) AS cluster FROM reach2 GROUP BY node"""
)
def stage2_clusters(spark, sf_dir):
    """Clusters inside the chunks that one round of substring keys makes."""
    prepared = pipeline.prepare(reads_of(spark, sf_dir), CONFIG)
    return pipeline.cluster_in_chunks(prepared, written(one_round_chunks(spark, sf_dir)), CONFIG).clusters


@query()
def stage3_clusters(spark, sf_dir):
    """The last stage from single reads on, with all its rounds."""
    prepared = pipeline.prepare(reads_of(spark, sf_dir), CONFIG)
    alone = prepared.reads.select("read_id", F.col("read_id").alias("cluster"))
    nothing = spark.createDataFrame([], "read_id bigint, score bigint")
    return pipeline.final_clustering(prepared, pipeline.State(alone, nothing), CONFIG).clusters


@query()
def full_run(spark, sf_dir):
    return pipeline.run(reads_of(spark, sf_dir), CONFIG).clusters


@query()
def run_report(spark, sf_dir):
    """The report of a run over all documents, against their labels, a line each; without the seconds, which differ by run."""
    result = pipeline.run(reads_of(spark, sf_dir), CONFIG)
    lines = pipeline.report(result, labelings(spark, sf_dir)[1], metrics.REGISTRY).split("\n")[1:]
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_pairs(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
