"""Queries over the driver's tables, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions import text as T
from ..operators import cluster, compare, forms, graph, pages, search, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table, dealt to all cores where it lies in fewer files than these: making and reading a file takes far longer than reading a row."""
    own, cores = read(spark, sf_dir, "part"), spark.sparkContext.defaultParallelism
    return own if len(own.inputFiles()) >= cores else own.repartition(cores)


# --- sensitive data -------------------------------------------------------------------------------------------------------

_EMAILS = r"list_filter(regexp_extract_all({c}, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]*'), lambda m: regexp_full_match(m, '[A-Za-z0-9_+-](?:[A-Za-z0-9._+-]*[A-Za-z0-9_+-])?@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}'))"
_PHONES = r"list_filter(list_transform(regexp_extract_all({c}, '[-0-9 ().+]+'), lambda r: regexp_extract(r, '(?:[+(][- ().+]*)?(?:[0-9][- ().+]*){{1,15}}$')), lambda p: len(regexp_replace(p, '[^0-9]', '', 'g')) >= 7)"
_LUHN = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN TRY_CAST(m[i] AS INT) WHEN TRY_CAST(m[i] AS INT) * 2 > 9 THEN TRY_CAST(m[i] AS INT) * 2 - 9 ELSE TRY_CAST(m[i] AS INT) * 2 END)) % 10 = 0"
_CARDS = "list_filter(regexp_extract_all({c}, '[0-9]+'), lambda m: len(m) = 16 AND " + _LUHN + ")"


def _counts(name: str):
    def run(spark, sf_dir):
        docs = read(spark, sf_dir, "documents")
        return docs.select("doc_id", F.size(P.matches(F.col("text"), name)).cast("long").alias("n")).where("n > 0")

    return run


for _name, _sql in (("email", _EMAILS), ("phone", _PHONES), ("card", _CARDS)):
    _f = _counts(_name)
    _f.__name__ = f"pii_{_name}"
    query(f"SELECT doc_id, n FROM (SELECT doc_id, CAST(len({_sql.format(c='text')}) AS BIGINT) AS n FROM documents) WHERE n > 0")(_f)


def _by(column: str):
    def run(spark, sf_dir):
        docs = read(spark, sf_dir, "documents")
        n = lambda c: F.sum(F.size(c)).cast("long")
        return docs.groupBy(column).agg(n(P.email(F.col("text"))).alias("n_email"), n(P.phone(F.col("text"))).alias("n_phone"), n(P.card(F.col("text"))).alias("n_card"))

    return run


for _name in ("lang", "source"):
    _f = _by(_name)
    _f.__name__ = f"pii_by_{_name}"
    query(
        f"SELECT {_name}, CAST(sum(len({_EMAILS.format(c='text')})) AS BIGINT) AS n_email, CAST(sum(len({_PHONES.format(c='text')})) AS BIGINT) AS n_phone, "
        f"CAST(sum(len({_CARDS.format(c='text')})) AS BIGINT) AS n_card FROM documents GROUP BY {_name}"
    )(_f)


@query(f"SELECT page_id, CAST(len({_EMAILS.format(c='html')}) AS BIGINT) AS n_email, CAST(len({_PHONES.format(c='html')}) AS BIGINT) AS n_phone, CAST(len({_CARDS.format(c='html')}) AS BIGINT) AS n_card FROM pages")
def pii_pages(spark, sf_dir):
    x = F.col("html")
    n = lambda c: F.size(c).cast("long")
    return read(spark, sf_dir, "pages").select("page_id", n(P.email(x)).alias("n_email"), n(P.phone(x)).alias("n_phone"), n(P.card(x)).alias("n_card"))


@query(
    "SELECT p_partkey, s AS ssn FROM (SELECT p_partkey, printf('id %03d-%02d-%04d;%d', p_partkey % 1000, p_size % 100, p_partkey % 10000, p_size) AS t, "
    "regexp_extract(t, '(?:^|[^0-9])([0-9]{3}-[0-9]{2}-[0-9]{4})(?:[^0-9]|$)', 1) AS s FROM part) WHERE s <> ''"
)
def pii_ssn(spark, sf_dir):
    t = F.format_string("id %03d-%02d-%04d;%d", F.col("p_partkey") % 1000, F.col("p_size") % 100, F.col("p_partkey") % 10000, F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(P.ssn(t)).alias("ssn"))


@query("SELECT p_partkey, r AS rfc FROM (SELECT p_partkey, regexp_extract(' ' || upper(left(p_name, 3)) || printf('%06d', p_partkey % 1000000) || 'A1B ', '[^A-Za-z0-9]([A-Z&Ñ]{3}[0-9]{6}[A-Z0-9]{3})[^A-Za-z0-9]', 1) AS r FROM part) WHERE r <> ''")
def pii_rfc(spark, sf_dir):
    t = F.concat(F.lit(" "), F.upper(F.substring("p_name", 1, 3)), F.format_string("%06d", F.col("p_partkey") % 1000000), F.lit("A1B "))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(P.rfc(t)).alias("rfc"))


@query("SELECT s_suppkey, c AS curp FROM (SELECT s_suppkey, regexp_extract('x ' || 'GARM' || printf('%06d', s_suppkey) || CASE WHEN s_suppkey % 3 = 0 THEN 'X' ELSE 'H' END || 'DFRRN0' || CAST(s_suppkey % 10 AS VARCHAR) || '.', '[^A-Za-z0-9]([A-Z]{4}[0-9]{6}[HM][A-Z]{5}[A-Z0-9][0-9])[^A-Za-z0-9]', 1) AS c FROM supplier) WHERE c <> ''")
def pii_curp(spark, sf_dir):
    k = F.col("s_suppkey")
    t = F.concat(F.lit("x GARM"), F.format_string("%06d", k), F.when(k % 3 == 0, "X").otherwise("H"), F.lit("DFRRN0"), (k % 10).cast("string"), F.lit("."))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(P.curp(t)).alias("curp"))


@query("SELECT o_orderkey, printf('%04d-%04d-%04d-%04d', o_orderkey % 10000, 0, o_custkey % 10000, 0) AS card FROM orders WHERE (SELECT " + _LUHN.replace("m[i]", "printf('%04d%04d%04d%04d', o_orderkey % 10000, 0, o_custkey % 10000, 0)[i]") + ")")
def pii_card_grouped(spark, sf_dir):
    t = F.format_string("n %04d-%04d-%04d-%04d.", F.col("o_orderkey") % 10000, F.lit(0), F.col("o_custkey") % 10000, F.lit(0))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.explode(P.card(t)).alias("card"))


@query(f"SELECT doc_id, list_reduce(list_concat([text], {_EMAILS.format(c='text')}), lambda a, m: replace(a, m, '[EMAIL]')) AS masked FROM documents WHERE contains(text, '@')")
def mask_email(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(F.contains("text", F.lit("@")))
    return docs.select("doc_id", P.mask(F.col("text"), P.email(F.col("text")), "[EMAIL]").alias("masked"))


@query("SELECT source, CAST(count(*) FILTER (WHERE contains(text, 'Apache License') OR contains(text, 'MIT License')) AS BIGINT) AS n FROM documents GROUP BY source")
def needle_repeats(spark, sf_dir):
    hit = P.repeats(F.col("text"), ["Apache License", "MIT License", "xyz"])
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(hit.cast("long")).alias("n"))


# --- search ---------------------------------------------------------------------------------------------------------------

_HITS = """
  SELECT doc_id, text, i AS hit, CAST(list_sum(list_transform(parts[1:i], lambda p: len(p))) + (i - 1) * 3 AS BIGINT) AS s
  FROM (SELECT doc_id, text, parts, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, text, string_split(text, 'the') AS parts FROM documents WHERE contains(text, 'the')))
"""


@query(f"SELECT doc_id, hit AS hit_no, CAST(s AS INT) AS char_start, CAST(s + 3 AS INT) AS char_end FROM ({_HITS}) WHERE hit <= 100")
def search_hits(spark, sf_dir):
    return search.search(read(spark, sf_dir, "documents"), "the", ["doc_id"]).select("doc_id", "hit_no", "char_start", "char_end")


@query(f"SELECT doc_id, CAST(max(hit) AS BIGINT) AS n FROM ({_HITS}) GROUP BY doc_id")
def search_count(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(F.contains("text", F.lit("the")))
    return docs.select("doc_id", F.size(search.positions(F.col("text"), "the")).cast("long").alias("n"))


@query(
    "SELECT doc_id, hit AS hit_no, left((CASE WHEN s > 48 THEN '…' ELSE '' END) || replace(substr(text, CAST(greatest(s - 48, 0) AS BIGINT) + 1, CAST(least(s + 3 + 48, len(text)) - greatest(s - 48, 0) AS BIGINT)), chr(10), ' ') "
    f"|| (CASE WHEN s + 51 < len(text) THEN '…' ELSE '' END), 240) AS snippet FROM ({_HITS}) WHERE hit <= 5"
)
def search_snippet(spark, sf_dir):
    return search.search(read(spark, sf_dir, "documents"), "the", ["doc_id"], max_hits=5).select("doc_id", "hit_no", "snippet")


@query("SELECT doc_id, CAST((len(f) - len(replace(f, 'ss', ''))) / 2 AS BIGINT) AS n FROM (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS f FROM documents)")
def search_ignore_case(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(search.spans_folded(F.col("text"), "SS")).cast("long").alias("n"))


@query(f"SELECT doc_id, hit_no FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id, s) AS INT) AS hit_no FROM (SELECT * FROM ({_HITS}) ORDER BY doc_id, s LIMIT 500)) WHERE hit_no <= 50")
def search_topk(spark, sf_dir):
    """The first 50 hits of the whole corpus in reading order."""
    docs = read(spark, sf_dir, "documents").where(F.contains("text", F.lit("the")))
    hits = docs.select("doc_id", F.explode(search.positions(F.col("text"), "the")).alias("s")).orderBy("doc_id", "s").limit(50)
    return hits.select("doc_id", F.row_number().over(Window.orderBy("doc_id", "s")).alias("hit_no"))


# --- scalar functions -----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(CASE WHEN p_size >= 20 THEN 1 WHEN p_size >= 16 THEN 2 WHEN p_size >= 13.5 THEN 3 ELSE 0 END AS INT) AS level FROM part")
def heading_level(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.heading_level(F.col("p_size")).alias("level"))


@query(
    "SELECT p_partkey, regexp_replace(ltrim(p_name || ' :__'), '[ :_.;-]+$', '') AS label, CASE WHEN p_size % 5 = 0 THEN 'checkbox' WHEN regexp_matches(lower(p_name), 'sign|firma|rubrica|witness') THEN 'signature' ELSE 'text' END AS kind, "
    "CASE WHEN p_size % 5 = 0 THEN 0.9 WHEN regexp_matches(lower(p_name), 'sign|firma|rubrica|witness') THEN 0.92 WHEN regexp_matches(lower(p_name), 'date|fecha|dob|birth|name|nombre|email|correo|phone|tel|cell|address|direccion|city|state|zip|postal|ssn|title|notes|comments') THEN 0.88 ELSE 0.8 END::DOUBLE AS confidence FROM part"
)
def classify_label(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("label", T.clean_label(F.concat("p_name", F.lit(" :__"))))
    square = F.col("p_size") % 5 == 0
    return part.select("p_partkey", "label", T.field_type(square, F.col("label")).alias("kind"), T.field_confidence(square, F.col("label"), F.lit(50.0), F.lit(14.0)).alias("confidence"))


@query("SELECT p_partkey, p_name || ',' || '\"' || replace(p_type || ', \"' || p_brand || '\"', '\"', '\"\"') || '\"' AS row FROM part")
def csv_row(spark, sf_dir):
    cells = F.array("p_name", F.concat("p_type", F.lit(', "'), "p_brand", F.lit('"')))
    return read(spark, sf_dir, "part").select("p_partkey", T.csv_row(cells).alias("row"))


@query("SELECT doc_id, '| ' || trim(replace(replace(replace(text, '|', '\\|'), chr(13), ''), chr(10), '<br/>')) || ' | ' || lang || ' |' AS row FROM documents WHERE contains(text, '|')")
def md_row(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(F.contains("text", F.lit("|")))
    return docs.select("doc_id", T.markdown_row(F.array("text", "lang")).alias("row"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS cell FROM pages")
def html_cell(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("cell"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') AS cell FROM documents")
def json_row(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.json_string(F.col("text")).alias("cell"))


@query("SELECT event_id, (CASE WHEN n >= 702 THEN chr(CAST(65 + (n - 702) // 676 AS INT)) || chr(CAST(65 + (n - 702) // 26 % 26 AS INT)) || chr(CAST(65 + (n - 702) % 26 AS INT)) WHEN n >= 26 THEN chr(CAST(65 + (n - 26) // 26 AS INT)) || chr(CAST(65 + (n - 26) % 26 AS INT)) ELSE chr(CAST(65 + n AS INT)) END) AS name FROM (SELECT event_id, event_id % 5000 AS n FROM events)")
def xlsx_column_name(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", T.column_name(F.col("event_id") % 5000).alias("name"))


@query("SELECT p_partkey, left(trim(replace(replace(p_type || '/' || p_brand || '[x]: sheet', '/', ''), '[', '').replace(']', '').replace(':', '')), 31) AS name FROM part")
def xlsx_sheet_name(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.sheet_name(F.concat("p_type", F.lit("/"), "p_brand", F.lit("[x]: sheet"))).alias("name"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, 'ffi', 'ﬃ'), 'ffl', 'ﬄ'), 'ff', 'ﬀ'), 'fi', 'ﬁ'), 'fl', 'ﬂ') AS composed, text AS back FROM documents")
def ligature_fold(spark, sf_dir):
    c = T.compose_ligatures(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", c.alias("composed"), T.decompose_ligatures(c).alias("back"))


@query("SELECT doc_id, regexp_replace(translate(text, 'áàâãåÁÀÂÃÅéèêëÉÈÊËíìîïÍÌÎÏóòôõÓÒÔÕúùûüÚÙÛÜñÑçÇß¿¡—–“”‘’…', 'aaaaaAAAAAeeeeEEEEiiiiIIIIooooOOOOuuuuUUUUnNcCs?!--\"\"''''.'), '[^\\x00-\\x7F]', '?', 'g') AS plain FROM documents")
def transliterate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.transliterate(F.col("text")).alias("plain"))


@query("SELECT page_id, regexp_matches(lower(url), '^https?://') AS allowed, lower(split_part(url, ':', 1)) AS scheme, lower(split_part(url, ':', 1)) IN ('javascript', 'jscript', 'livescript', 'vbscript', 'file', 'data') AS dangerous FROM pages")
def url_checks(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", T.url_allowed(u).alias("allowed"), T.url_scheme(u).alias("scheme"), T.url_dangerous(u).alias("dangerous"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, 'D:%Y%m%d%H%M%SZ') AS pdf FROM orders")
def pdf_date(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("pdf", F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("Z")))
    iso = T.pdf_date_to_iso(F.col("pdf"))
    return orders.select("o_orderkey", iso.alias("iso"), T.iso_to_pdf_date(iso).alias("pdf"))


@query("SELECT doc_id, 'Page ' || CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR) || ' of ' || CAST(count(*) OVER (PARTITION BY source) AS VARCHAR) AS label FROM documents")
def bates_label(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    own = Window.partitionBy("source")
    return docs.select("doc_id", T.page_label("Page {page} of {total}", F.row_number().over(own.orderBy("doc_id")), F.count("*").over(own)).alias("label"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN r < 45 OR r >= 315 THEN 0 WHEN r < 135 THEN 90 WHEN r < 225 THEN 180 ELSE 270 END AS INT) AS rotation FROM (SELECT l_orderkey, l_linenumber, ((l_partkey - 5000) % 360 + 360) % 360 AS r FROM lineitem)")
def rotation_norm(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.normal_rotation(F.col("l_partkey") - 5000).alias("rotation"))


@query("SELECT l_orderkey, l_linenumber, round(2 * l_quantity + 0.5 * l_extendedprice + 10, 6) AS x, round(-1 * l_quantity + 3 * l_extendedprice - 20, 6) AS y FROM lineitem")
def affine_point(spark, sf_dir):
    m = G.matrix(*(F.lit(float(v)) for v in (2, -1, 0.5, 3, 10, -20)))
    p = G.transform(m, F.col("l_quantity"), F.col("l_extendedprice"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


@query("SELECT s_suppkey, (p & 4) <> 0 AS can_print, (p & 16) <> 0 AS can_copy, (p & 256) <> 0 OR (p & 32) <> 0 AS can_fill, (p & 1024) <> 0 OR (p & 8) <> 0 AS can_assemble, (p & 8) <> 0 AND (p & 32) <> 0 AS can_create FROM (SELECT s_suppkey, CAST(s_suppkey * 37 % 4096 AS INT) AS p FROM supplier)")
def perms_decode(spark, sf_dir):
    p = F.col("s_suppkey") * 37 % 4096
    return read(spark, sf_dir, "supplier").select("s_suppkey", *(G.allows(p, a).alias(n) for a, n in (("print", "can_print"), ("copy", "can_copy"), ("fill", "can_fill"), ("assemble", "can_assemble"), ("create_field", "can_create"))))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def digests(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


# --- geometry, tables, forms ----------------------------------------------------------------------------------------------

_RECTS = "(SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_tax * 100 AS y0, l_quantity + 10 + l_discount * 100 AS x1, l_tax * 100 + 12 AS y1 FROM lineitem)"


def _rects(spark, sf_dir) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_tax") * 100
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.rect(x, y, x + 10 + F.col("l_discount") * 100, y + 12).alias("box"))


@query(f"SELECT l_orderkey, round(min(x0), 6) AS min_x, round(min(y0), 6) AS min_y, round(max(x1), 6) AS max_x, round(max(y1), 6) AS max_y FROM {_RECTS} GROUP BY l_orderkey")
def bbox_union(spark, sf_dir):
    boxes = _rects(spark, sf_dir).groupBy("l_orderkey").agg(G.union(F.col("box")).alias("b"))
    return boxes.select("l_orderkey", *(F.round(F.col(f"b.{s}"), 6).alias(s) for s in G.SIDES))


@query(
    "SELECT l_orderkey, a, b, round(w * h / (aw * ah + bw * bh - w * h), 6) AS iou FROM (SELECT p.l_orderkey, p.l_linenumber AS a, q.l_linenumber AS b, least(p.x1, q.x1) - greatest(p.x0, q.x0) AS w, least(p.y1, q.y1) - greatest(p.y0, q.y0) AS h, "
    f"p.x1 - p.x0 AS aw, p.y1 - p.y0 AS ah, q.x1 - q.x0 AS bw, q.y1 - q.y0 AS bh FROM {_RECTS} p JOIN {_RECTS} q ON p.l_orderkey = q.l_orderkey AND p.l_linenumber < q.l_linenumber) WHERE w > 0 AND h > 0"
)
def iou_pairs(spark, sf_dir):
    r = _rects(spark, sf_dir)
    p, q = r.select("l_orderkey", F.col("l_linenumber").alias("a"), F.col("box").alias("p")), r.select("l_orderkey", F.col("l_linenumber").alias("b"), F.col("box").alias("q"))
    pairs = p.join(q, "l_orderkey").where("a < b").withColumn("iou", G.iou(F.col("p"), F.col("q")))
    return pairs.where("iou > 0").select("l_orderkey", "a", "b", F.round("iou", 6).alias("iou"))


@query(
    f"SELECT p.l_orderkey, p.l_linenumber AS a, CAST(count(*) AS BIGINT) AS inside FROM {_RECTS} p JOIN {_RECTS} q ON p.l_orderkey = q.l_orderkey AND p.l_linenumber <> q.l_linenumber "
    "AND (q.x0 + q.x1) / 2 BETWEEN p.x0 - 0.5 AND p.x1 + 0.5 AND (q.y0 + q.y1) / 2 BETWEEN p.y0 - 0.5 AND p.y1 + 0.5 GROUP BY ALL"
)
def point_in_box(spark, sf_dir):
    r = _rects(spark, sf_dir)
    cells, spans = r.select("l_orderkey", F.col("l_linenumber").alias("a"), F.col("box").alias("cell")), r.select("l_orderkey", F.col("l_linenumber").alias("b"), F.col("box").alias("span"))
    hit = cells.join(spans, "l_orderkey").where((F.col("a") != F.col("b")) & G.centre_inside(F.col("span"), F.col("cell"), 0.5))
    return hit.groupBy("l_orderkey", "a").agg(F.count("*").alias("inside"))


@query(
    "WITH f AS (SELECT event_id AS field, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'purchase'), l AS (SELECT event_id AS label, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type <> 'purchase'), "
    "d AS (SELECT field, label, f.t - l.t AS gap FROM f JOIN l ON f.user_id = l.user_id AND l.t <= f.t) SELECT field, arg_min(label, (gap, label)) AS label FROM d GROUP BY field"
)
def nearest_label(spark, sf_dir):
    ev = read(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    fields = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("field"), "user_id", F.col("t").alias("at"))
    labels = ev.where("event_type <> 'purchase'").select(F.col("event_id").alias("label"), "user_id", "t")
    return forms.nearest_before(fields, labels, ["user_id"], "field", "label", "at", "t")


@query(
    "SELECT user_id, island, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS island FROM (SELECT user_id, event_id, ts, "
    "CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 HOUR OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, island"
)
def spans_islands(spark, sf_dir):
    keys, order = ["user_id"], ["ts", "event_id"]
    prev = lambda c: cluster.previous(c, keys, order)
    gap = (F.col("ts") - prev("ts") > F.expr("interval 1 hour")) | (prev("event_type") != F.col("event_type"))
    runs = cluster.islands(read(spark, sf_dir, "events"), keys, order, gap)
    return runs.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(
    "WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i FROM events), "
    "r AS (SELECT user_id, i, value AS head, 0 AS g FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, CASE WHEN abs(e.value - r.head) > 5.0 THEN e.value ELSE r.head END, r.g + CASE WHEN abs(e.value - r.head) > 5.0 THEN 1 ELSE 0 END "
    "FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, CAST(max(g) AS INT) AS groups FROM r GROUP BY user_id"
)
def line_fold(spark, sf_dir):
    """Groups of a user's values within a tolerance of their group's first."""
    ev = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("value")).alias("v"))
    return ev.select("user_id", F.array_max(cluster.anchored(F.col("v"), 5.0)).alias("groups"))


@query(
    "WITH RECURSIVE e AS (SELECT p_brand, p_retailprice AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS i FROM part), "
    "r AS (SELECT p_brand, i, CAST(x AS DOUBLE) AS mean, 1 AS n, 1 AS levels FROM e WHERE i = 1 UNION ALL SELECT e.p_brand, e.i, CASE WHEN abs(e.x - r.mean) <= 2.5 THEN (r.mean * r.n + e.x) / (r.n + 1) ELSE CAST(e.x AS DOUBLE) END, "
    "CASE WHEN abs(e.x - r.mean) <= 2.5 THEN r.n + 1 ELSE 1 END, r.levels + CASE WHEN abs(e.x - r.mean) <= 2.5 THEN 0 ELSE 1 END FROM r JOIN e ON e.p_brand = r.p_brand AND e.i = r.i + 1) "
    "SELECT p_brand, CAST(max(levels) AS INT) AS levels FROM r GROUP BY p_brand"
)
def level_cluster(spark, sf_dir):
    """Price levels of each brand by running means."""
    part = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list("p_retailprice")).alias("v"))
    return part.select("p_brand", F.size(cluster.running_means(F.col("v"), 2.5)).alias("levels"))


@query(
    "SELECT k, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi FROM (SELECT k, lo, hi, sum(n) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT k, lo, hi, CASE WHEN lo - max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3 THEN 0 ELSE 1 END AS n "
    "FROM (SELECT CAST(p_size AS INT) AS k, p_retailprice AS lo, p_retailprice + p_size AS hi FROM part))) GROUP BY k, g"
)
def interval_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_size").alias("k"), F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_size")).alias("hi"))
    return cluster.merged_intervals(rows, ["k"], "lo", "hi", 3.0).select("k", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("SELECT o_orderstatus, string_agg(row, chr(13) || chr(10) ORDER BY o_orderkey) AS csv FROM (SELECT o_orderstatus, o_orderkey, CAST(o_orderkey AS VARCHAR) || ',' || o_orderpriority AS row FROM orders) GROUP BY o_orderstatus")
def table_csv(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    rows = orders.select("o_orderstatus", F.col("o_orderkey").alias("row_idx"), F.array(F.col("o_orderkey").cast("string"), "o_orderpriority").alias("cells"))
    return tables.csv(rows, ["o_orderstatus"])


# --- documents ------------------------------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS digest, min(doc_id) AS keeper, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY sha256(text)")
def dedup_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("keeper"), F.count("*").alias("copies"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS keeper FROM documents")
def dedup_remap(spark, sf_dir):
    return graph.content_copies(read(spark, sf_dir, "documents").withColumn("k", F.lit(0)), ["k"], "doc_id", "text").select("doc_id", "keeper")


@query(
    "SELECT coalesce(a.c_custkey, b.c_custkey) AS k, CASE WHEN b.c_custkey IS NULL THEN 'deleted' WHEN a.c_custkey IS NULL THEN 'added' WHEN abs(a.c_acctbal - b.bal) > 0.5 THEN 'modified' ELSE 'unchanged' END AS status "
    "FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 7 <> 0) a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal FROM customer WHERE c_custkey % 11 <> 0) b ON a.c_custkey = b.c_custkey"
)
def page_outer_diff(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    base = c.where("c_custkey % 7 <> 0").select(F.lit(0).alias("d"), F.col("c_custkey").alias("page_index"), F.col("c_acctbal").alias("width"), F.lit(1.0).alias("height"))
    other = c.where("c_custkey % 11 <> 0").select(F.lit(0).alias("d"), F.col("c_custkey").alias("page_index"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("width"), F.lit(1.0).alias("height"))
    return compare.compare_pages(base, other, ["d"]).select(F.col("page_index").alias("k"), "status")


@query(
    "SELECT c_custkey, 'author' AS field, c_mktsegment AS base_value, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower(c_mktsegment) END AS target_value FROM customer UNION ALL "
    "SELECT c_custkey, 'title', c_name, c_name || '!' FROM customer WHERE c_custkey % 4 = 0"
)
def metadata_diff(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    base = c.select("c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"))
    other = c.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.concat("c_name", F.lit(" "))).alias("title"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.lower("c_mktsegment")).alias("author"))
    out = compare.diff_metadata(base, other, ["c_custkey"], ("title", "author"))
    return out.select("c_custkey", "field", "base_value", F.nullif("target_value", F.lit(" ")).alias("target_value"))


@query("SELECT conv_id, CAST(turn // 2 AS INT) AS part, CAST(turn % 2 AS INT) AS page_index, CAST(len(text) AS BIGINT) AS n FROM conversations")
def split_chunks(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumnRenamed("turn", "page_index")
    return pages.split(c, 2).select("conv_id", "part", "page_index", F.length("text").cast("long").alias("n"))


@query("SELECT conv_id, CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS page_index, role FROM conversations")
def merge_renumber(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumnRenamed("turn", "page_index")
    return pages.merge([c], "conv_id").select("conv_id", "page_index", "role")


@query("WITH l AS (SELECT *, count(*) FILTER (WHERE turn <> 0) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS page_index, role, CASE WHEN n = 0 THEN 'CANNOT_DELETE_ALL' ELSE 'OK' END AS status FROM l WHERE turn <> 0 OR n = 0")
def delete_pages(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumnRenamed("turn", "page_index")
    return pages.delete(c, [0], "conv_id").select("conv_id", "page_index", "role", "status")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS INT) AS page_index, sha256(text) AS h FROM conversations")
def reorder_pages(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumnRenamed("turn", "page_index")
    return pages.reverse(c, "conv_id").select("conv_id", "page_index", F.sha2("text", 256).alias("h"))


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), lang) AS subject, coalesce(CAST(toxic AS VARCHAR), source) AS keywords FROM documents LEFT JOIN labels USING (doc_id)")
def coalesce_metadata(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.col("quality").cast("string"), "lang").alias("subject"), F.coalesce(F.col("toxic").cast("string"), "source").alias("keywords"))


def _tree(spark, sf_dir) -> DataFrame:
    """Regions, nations and customers as a page tree: (k, node, parent, box)."""
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), (F.col("r_regionkey") * 100).cast("long").alias("box"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey")).cast("long"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey")).cast("long"))
    return r.union(n).union(c).withColumn("k", F.lit(0))


@query("SELECT 'c' || c_custkey AS node, CAST(CASE WHEN c_custkey % 10 = 0 THEN c_custkey WHEN n_nationkey % 3 = 0 THEN n_nationkey ELSE n_regionkey * 100 END AS BIGINT) AS box FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inherit_box(spark, sf_dir):
    return graph.inherited(_tree(spark, sf_dir), ["k"], "node", "parent", "box").where(F.col("node").startswith("c")).select("node", "box")


@query("SELECT 'r1' AS node UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def reachability(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    edges = tree.where("parent is not null").select("k", F.col("parent").alias("src"), F.col("node").alias("dst"))
    return graph.reachable(edges, spark.sql("select 0 as k, 'r1' as node"), "k").select("node")


@query("SELECT 'r' || r_regionkey AS node, 'c' || (SELECT min(CAST(c_custkey AS VARCHAR)) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS component FROM region")
def components(spark, sf_dir):
    tree = _tree(spark, sf_dir).where("parent is not null")
    return graph.components(tree, ["k"], "node", "parent").where(F.col("node").startswith("r")).select("node", "component")


@query()
def word_lcs(spark, sf_dir):
    """How alike a conversation's turns are to the ones before them."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(own)).where("before is not null")
    d = compare.word_diff(F.col("before"), F.col("text"))
    return turns.select("conv_id", "turn", d.alias("d")).select("conv_id", "turn", F.round("d.likeness", 6).alias("likeness"), F.size("d.words").alias("words"))


@query()
def reflow(spark, sf_dir):
    """Turns broken into lines of at most 300 points."""
    from ..sources.pdf.edit import reflow as flow
    from ..sources.pdf.edit import width_of

    @F.pandas_udf("struct<lines:int,widest:double>")
    def run(text):
        import pandas as pd

        own = [flow(t or "", 300.0, lambda x: width_of(x, 12.0)) for t in text]
        return pd.DataFrame({"lines": [len(x) for x in own], "widest": [max((y["width"] for y in x), default=0.0) for x in own]})

    return read(spark, sf_dir, "conversations").select("conv_id", "turn", run("text").alias("r")).select("conv_id", "turn", "r.lines", "r.widest")


# --- PDF files made from the tables ---------------------------------------------------------------------------------------


def part_files(spark, sf_dir) -> DataFrame:
    """A file for each part: a title, a ruled table of two rows, an e-mail address, and metadata."""
    from ..sources.pdf import build

    @F.pandas_udf("binary")
    def made(key, name, brand, size):
        import pandas as pd

        rules = b"".join(b"%d 600 m %d 700 l S " % (x, x) for x in (100, 250, 400)) + b"".join(b"100 %d m 400 %d l S " % (y, y) for y in (600, 650, 700))
        out = []
        for k, n, b, s in zip(key, name, brand, size):
            lines = [(72, 750, n, 18), (110, 670, "Brand", 12), (260, 670, "Size", 12), (110, 620, b, 12), (260, 620, str(s), 12), (72, 500, f"mail p{k}@example.com now", 12)]
            out.append(build.simple([lines], info={"Title": n, "Author": b}, rules=[rules]))
        return pd.Series(out)

    part = parts(spark, sf_dir)
    return part.select(F.col("p_partkey").cast("string").alias("doc_id"), "p_name", "p_brand", "p_size", made("p_partkey", "p_name", "p_brand", "p_size").alias("content"))


_PARTS = "(SELECT CAST(p_partkey AS VARCHAR) AS doc_id, * FROM part)"


@query(f"SELECT doc_id, unnest([p_name, 'Brand Size', p_brand || ' ' || CAST(p_size AS VARCHAR), 'mail p' || doc_id || '@example.com now']) AS text FROM {_PARTS}")
def pdf_scan(spark, sf_dir):
    from ..sources.pdf.scan import scan

    return scan(part_files(spark, sf_dir), "lines").select("doc_id", "text")


@query(f"SELECT doc_id, unnest([p_name, 'Brand Size', p_brand || ' ' || CAST(p_size AS VARCHAR), 'mail p' || doc_id || '@example.com now']) AS text FROM {_PARTS}")
def pdf_lines_from_glyphs(spark, sf_dir):
    """Glyphs read from the files; spans and lines by windows and folds."""
    from ..operators import layout
    from ..sources.pdf.scan import scan

    return layout.lines(layout.spans(scan(part_files(spark, sf_dir), "glyphs"))).select("doc_id", "text")


@query(f"SELECT doc_id, unnest([0, 0, 1, 1]) AS row_idx, unnest([0, 1, 0, 1]) AS col_idx, unnest(['Brand', 'Size', p_brand, CAST(p_size AS VARCHAR)]) AS text FROM {_PARTS}")
def pdf_tables(spark, sf_dir):
    from ..sources.pdf.scan import scan

    return scan(part_files(spark, sf_dir), "table_cells").select("doc_id", "row_idx", "col_idx", "text")


@query(f"SELECT doc_id, p_name AS title, p_brand AS author FROM {_PARTS}")
def pdf_metadata(spark, sf_dir):
    from ..sources.pdf.scan import scan

    return scan(part_files(spark, sf_dir), "metadata").select("doc_id", "title", "author")


@query(f"SELECT doc_id, CAST(0 AS BIGINT) AS emails, 'mail' AS before, 'now' AS after FROM {_PARTS}")
def pdf_redact_email(spark, sf_dir):
    """E-mail addresses taken out of the files; then the files are read again."""
    import re

    from ..operators.documents import change
    from ..sources.pdf.scan import scan

    clean = change(part_files(spark, sf_dir), "redact_pattern", re.compile(r"[\w.]+@[\w.]+"), label="")
    lines = scan(clean.select("doc_id", "content"), "paragraphs").where(F.col("text").startswith("mail"))
    word = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    return lines.select("doc_id", F.size(P.email(F.col("text"))).cast("long").alias("emails"), word[0].alias("before"), F.element_at(word, -1).alias("after"))


@query(f"SELECT doc_id, '# ' || p_name AS first_line FROM {_PARTS}")
def pdf_markdown(spark, sf_dir):
    from ..operators.documents import export_as

    md = export_as(part_files(spark, sf_dir), "markdown")
    return md.select("doc_id", F.regexp_replace(F.substring_index(F.decode("content", "utf-8"), "\n", 1), "^#+ ", "# ").alias("first_line"))


@query(f"SELECT CAST(p_size AS INT) AS k, CAST(count(*) AS INT) AS n_pages FROM {_PARTS} GROUP BY p_size")
def pdf_merge(spark, sf_dir):
    from ..operators.documents import merge
    from ..sources.pdf.scan import scan

    whole = merge(part_files(spark, sf_dir).withColumnRenamed("p_size", "k"), ["k"], ["doc_id"])
    return scan(whole.select(F.col("k").cast("string").alias("doc_id"), "content"), "documents").select(F.col("doc_id").cast("int").alias("k"), "n_pages")
