"""The conformance queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitgate import oracles as o
from fitgate.functions import decide as dec
from fitgate.functions import formatting as fmt
from fitgate.functions import prepared as prep
from fitgate.functions import registry as reg
from fitgate.functions.registry import FORMATS
from fitgate.operators import asof, bookkeeping, coded_headers, headers, rules_text, sheets, size_search
from fitgate.operators import html_fields as html
from fitgate.plans import page_events, views
from fitgate.session import shared_folder
from fitgate.sources import heads, store
from fitgate.streaming import catalog as streams
from fitgate.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(streams.QUERIES)
SQL: dict[str, str] = dict(streams.SQL)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _join(c: Column | str) -> Column:
    return F.array_join(c, ",")


def _lists() -> tuple[Column, Column]:
    return F.col("accepted_mimes"), F.col("accepted_exts")


_PAIRS = "SELECT field_id, d.format FROM fields f CROSS JOIN dim d WHERE {not_}" + o.allowed("d.format", "d.kind", "d.family_mimes", "d.family_exts")
_CONVERTIBLE = f"""CASE WHEN d.kind = 'sheet' THEN ({o.one_allowed('xlsx')} AND d.format <> 'xlsx') OR ({o.one_allowed('csv')} AND d.format <> 'csv')
    ELSE len({o.outputs()}) > 0 OR {o.one_allowed('pdf')} END"""


# formats


@query(o.with_views("SELECT ord, format, label, array_to_string(mimes, ',') AS mimes, array_to_string(exts, ',') AS exts, kind, writable FROM dim", o.DIM))
def dim_formats(spark, sf_dir):
    return reg.dim_format(spark).select("ord", "format", "label", _join("mimes").alias("mimes"), _join("exts").alias("exts"), "kind", "writable")


@query(o.with_views(
    "SELECT file_id, coalesce(d.mimes[1], trim(split_part(lower(mime), ';', 1))) AS canonical, d.format AS format FROM files f LEFT JOIN dim d ON list_contains(d.mimes, trim(split_part(lower(mime), ';', 1)))",
    o.DIM, o.FILES.replace("ELSE " + o._MIMES + "[doc_id % 17 + 1] END AS mime", "ELSE " + o._MIMES + "[doc_id % 17 + 1] || '; q=1' END AS mime"),
))
def mime_normalise(spark, sf_dir):
    mime = F.when(F.col("file_id") % 5 > 1, F.concat("mime", F.lit("; q=1"))).otherwise(F.col("mime"))
    return views.files(spark, sf_dir).select("file_id", reg.normalize_mime(mime).alias("canonical"), reg.format_from_mime(mime).alias("format"))


@query(o.with_views(
    "SELECT file_id, d.format AS format, d.mimes[1] AS mime FROM files f LEFT JOIN dim d ON list_contains(d.exts, lower(regexp_extract(name, '\\.[^.]+$')))", o.DIM, o.FILES
))
def ext_lookup(spark, sf_dir):
    """A real lookup join: files to the exploded extension dimension, which is always broadcast."""
    ext = F.broadcast(reg.dim_format(spark).select("format", F.explode("exts").alias("ext")))
    files = views.files(spark, sf_dir).select("file_id", F.lower(F.regexp_extract("name", r"\.[^.]+$", 0)).alias("ext"))
    return files.join(ext, "ext", "left").select("file_id", "format", reg.mime_of(F.col("format")).alias("mime"))


@query(o.with_views(
    """SELECT file_id, CASE WHEN e.format = 'csv' THEN 'csv' ELSE coalesce(m.format, e.format, 'unknown') END AS guess FROM files f
    LEFT JOIN dim e ON list_contains(e.exts, lower(regexp_extract(name, '\\.[^.]+$'))) LEFT JOIN dim m ON list_contains(m.mimes, lower(mime))""", o.DIM, o.FILES
))
def format_guess(spark, sf_dir):
    return views.files(spark, sf_dir).select("file_id", reg.guess_format(F.col("name"), F.col("mime")).alias("guess"))


@query(o.with_views("SELECT file_id, field_id, coalesce(taken, false) AS allowed FROM rated", *o.BASE, o.RATED))
def format_allowed(spark, sf_dir):
    return views.picks(spark, sf_dir).select("file_id", "field_id", dec.allowed(F.col("format"), F.col).alias("allowed"))


@query(o.with_views(f"SELECT field_id, array_to_string({o.outputs()}, ',') AS outputs FROM fields", o.FIELDS))
def allowed_outputs(spark, sf_dir):
    return views.fields(spark, sf_dir).select("field_id", _join(reg.allowed_outputs(F.col("taken"))).alias("outputs"))


@query(o.with_views(
    f"""SELECT file_id, array_to_string(CASE WHEN format = 'unknown' THEN [] WHEN kind = 'sheet' THEN list_filter([CASE WHEN {o.one_allowed('xlsx')} AND format <> 'xlsx' THEN 'xlsx' END,
      CASE WHEN {o.one_allowed('csv')} AND format <> 'csv' THEN 'csv' END], lambda x: x IS NOT NULL)
    WHEN format = 'pdf' THEN list_concat(CASE WHEN {o.one_allowed('pdf')} THEN ['pdf'] ELSE [] END, outputs)
    ELSE list_concat(outputs, CASE WHEN {o.one_allowed('pdf')} THEN ['pdf'] ELSE [] END) END, ',') AS targets FROM rated""", *o.BASE, o.RATED,
))
def conversion_targets(spark, sf_dir):
    return views.picks(spark, sf_dir).select("file_id", _join(reg.conversion_targets(F.col("format"), F.col("taken"))).alias("targets"))


@query(o.with_views(
    "SELECT field_id, len(accepted_exts) > 0 OR len(list_filter(accepted_mimes, lambda m: m NOT LIKE '%/*')) > 0 AS specific FROM fields", o.FIELDS
))
def specific_list(spark, sf_dir):
    return views.fields(spark, sf_dir).select("field_id", reg.is_specific(*_lists()).alias("specific"))


@query(o.with_views(
    f"""SELECT f.field_id, CASE WHEN NOT list_contains(list_transform(f.accepted_mimes, lambda m: m LIKE '%/*'), true) AND len(f.accepted_mimes) + len(f.accepted_exts) > 0
      THEN array_to_string(list_concat(f.accepted_mimes, f.accepted_exts), ',') || ',' || e.extra END AS accept
    FROM fields f LEFT JOIN (SELECT field_id, string_agg(array_to_string(d.exts, ',') || ',' || d.mimes[1], ',' ORDER BY d.ord) AS extra
      FROM fields f CROSS JOIN dim d WHERE NOT {o.allowed('d.format', 'd.kind', 'd.family_mimes', 'd.family_exts')} AND {_CONVERTIBLE} GROUP BY field_id) e USING (field_id)""", o.DIM, o.FIELDS,
))
def widened_accept(spark, sf_dir):
    accept = F.concat_ws(",", *_lists())
    return views.fields(spark, sf_dir).select("field_id", reg.widened_accept(accept, *_lists(), F.col("taken")).alias("accept"))


# decisions


@query(o.with_views(f"SELECT field_id, {o.SAFE_MIN}::BIGINT AS safe_min FROM fields WHERE min_bytes IS NOT NULL", o.FIELDS))
def safe_minimum(spark, sf_dir):
    return views.fields(spark, sf_dir).where("min_bytes is not null").select("field_id", dec.safe_minimum(F.col("min_bytes")).alias("safe_min"))


def _guessed(spark, sf_dir) -> DataFrame:
    return views.picks(spark, sf_dir).withColumn("guess", reg.guess_format(F.col("name"), F.col("mime")))


_NEEDS_WORK = f"""CASE WHEN bytes = 0 OR format = 'unknown' THEN false
      WHEN NOT coalesce(taken, false) THEN CASE WHEN kind = 'sheet' THEN ({o.one_allowed('xlsx')} AND format <> 'xlsx') OR ({o.one_allowed('csv')} AND format <> 'csv')
        ELSE len(outputs) > 0 OR {o.one_allowed('pdf')} END
      WHEN kind = 'sheet' THEN false WHEN bytes > max_bytes THEN true WHEN format = 'pdf' THEN false WHEN bytes < {o.SAFE_MIN} THEN true
      WHEN dpi > 0 AND format IN ('jpeg', 'png') THEN true ELSE len(outputs) > 0 AND {o.HAS_DIMS} END"""


@query(o.with_views(f"SELECT r.file_id, {_NEEDS_WORK} AS needs_work FROM rated r", *o.BASE, o.RATED))
def might_need_work(spark, sf_dir):
    return _guessed(spark, sf_dir).select("file_id", dec.might_need_work(F.col("guess"), F.col("bytes"), F.col).alias("needs_work"))


@query(o.with_views("SELECT file_id, field_id, array_to_string(issues, ',') AS issues FROM issued", *o.BASE, o.RATED, o.ISSUES))
def compatibility_issues(spark, sf_dir):
    return views.picks(spark, sf_dir).select("file_id", "field_id", _join(dec.issues(views.facts, F.col)).alias("issues"))


def _decided(spark, sf_dir) -> DataFrame:
    p = views.picks(spark, sf_dir).withColumns({"found": dec.issues(views.facts, F.col), "output": dec.choose_output(views.facts, F.col)})
    return p.withColumn("d", dec.decision(views.facts, F.col, F.col("found"), F.col("output")))


_DECIDED = (*o.BASE, o.RATED, o.ISSUES, o.DECIDED)


@query(o.with_views(
    """SELECT file_id, field_id, action, array_to_string(issues, ',') AS issues, CASE WHEN action IN ('AUTO_FIX', 'USER_CONFIRMATION') THEN output END AS output_format,
    CASE WHEN action = 'USER_CONFIRMATION' THEN array_to_string(wants, ',') ELSE '' END AS consents FROM decided""", *_DECIDED
))
def file_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select("file_id", "field_id", "d.action", _join("d.issues").alias("issues"), "d.output_format", _join("d.consents").alias("consents"))


@query(o.with_views(
    """SELECT file_id, CASE action WHEN 'PASS_THROUGH' THEN 'pass' WHEN 'UNSAFE_TO_FIX' THEN 'unsafe' WHEN 'AUTO_FIX' THEN 'fixed' ELSE 'confirm' END AS kind,
    CASE WHEN action = 'UNSAFE_TO_FIX' THEN CASE WHEN list_contains(issues, 'unknown') THEN 'damaged' ELSE 'rules-conflict' END END AS code FROM decided""", *_DECIDED
))
def prepare_outcome(spark, sf_dir):
    """What becomes of each chosen file: it passes, is fixed, waits for a confirmation, or cannot be helped, and why."""
    return _decided(spark, sf_dir).select("file_id", dec.prepare_outcome(F.col("d.action"), F.col("d.issues")).alias("o")).select("file_id", "o.*")


@query(o.with_views("SELECT format, action, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM decided GROUP BY ALL", *_DECIDED))
def decisions_by_format(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("format", "d.action").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query(o.with_views("SELECT c AS consent, count(*) AS n FROM (SELECT unnest(wants) AS c FROM decided WHERE action = 'USER_CONFIRMATION') GROUP BY c", *_DECIDED))
def consents(spark, sf_dir):
    return _decided(spark, sf_dir).select(F.explode("d.consents").alias("consent")).groupBy("consent").agg(F.count(F.lit(1)).alias("n"))


@query(o.with_views("SELECT file_id, output FROM chosen", *o.BASE, o.RATED, o.ISSUES, o.DECIDED.split(",\n  scaled")[0]))
def choose_output(spark, sf_dir):
    return views.picks(spark, sf_dir).select("file_id", dec.choose_output(views.facts, F.col).alias("output"))


@query("""SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 0 THEN 'shrink' WHEN doc_id % 2 = 0 AND n_chars % 101 < 97 AND doc_id % 5 <> 0 THEN 'quality' END AS ask FROM documents""")
def result_consent(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    return d.select(i.alias("file_id"), dec.result_consent(F.col("n_chars") % 101, i % 2 == 0, i % 3 == 0, i % 5 != 0).alias("ask"))


_SHIFTED = """shifted AS (SELECT field_id, CASE WHEN field_id % 5 = 1 THEN 90000000 ELSE min_bytes END AS min_bytes, max_bytes, min_width, min_height,
  CASE WHEN field_id % 7 = 1 THEN 50 ELSE max_width END AS max_width, max_height, exact_width, exact_height,
  CASE WHEN field_id % 4 = 2 THEN 2.0::DOUBLE ELSE aspect_ratio END AS aspect_ratio FROM fields)"""


@query(o.with_views(
    """SELECT field_id, coalesce(min_bytes > max_bytes, false) OR coalesce(min_width > max_width, false) OR coalesce(min_height > max_height, false)
    OR coalesce(exact_width < min_width, false) OR coalesce(exact_width > max_width, false) OR coalesce(exact_height < min_height, false) OR coalesce(exact_height > max_height, false)
    OR coalesce(abs(exact_width - exact_height * aspect_ratio) > greatest(1.0, aspect_ratio), false) AS conflict FROM shifted""", o.FIELDS, _SHIFTED
))
def rule_conflicts(spark, sf_dir):
    i = F.col("field_id")
    f = views.fields(spark, sf_dir).withColumns({
        "min_bytes": F.when(i % 5 == 1, 90_000_000).otherwise(F.col("min_bytes")), "max_width": F.when(i % 7 == 1, 50).otherwise(F.col("max_width")),
        "aspect_ratio": F.when(i % 4 == 2, 2.0).otherwise(F.col("aspect_ratio")),
    })
    return f.select("field_id", dec.conflicting(F.col).alias("conflict"))


@query(o.with_views("SELECT field_id, coalesce(max_width, max_height, exact_width, exact_height) IS NOT NULL AS stated FROM fields", o.FIELDS))
def states_pixel_size(spark, sf_dir):
    return views.fields(spark, sf_dir).select("field_id", dec.states_pixel_size(F.col).alias("stated"))


@query(o.with_views(
    f"""SELECT file_id, CASE WHEN kind = 'sheet' THEN 'sheet' WHEN format = 'pdf' AND {o.one_allowed('pdf')} AND bytes > max_bytes THEN 'pdf-shrink'
    WHEN format = 'pdf' AND {o.one_allowed('pdf')} THEN 'pdf-pass' WHEN format = 'pdf' AND len(outputs) > 0 THEN 'pdf-page' WHEN format = 'pdf' THEN 'pdf-pass'
    WHEN {o.one_allowed('pdf')} AND len(outputs) = 0 THEN 'image-pdf' ELSE 'image' END AS route FROM rated""", *o.BASE, o.RATED,
))
def file_route(spark, sf_dir):
    return views.picks(spark, sf_dir).select("file_id", dec.route(F.col("format"), F.col("bytes"), F.col).alias("route"))


# geometry


@query(o.with_views(
    f"""SELECT file_id, round((width - cw) / 2, 6) + 0.0 AS x, round((height - cw / q) / 2, 6) + 0.0 AS y, round(cw, 6) AS w, round(cw / q, 6) AS h
    FROM (SELECT *, {o.RATIO} AS q, least(width::DOUBLE, height * {o.RATIO}) AS cw FROM picks) WHERE q IS NOT NULL""", *o.BASE,
))
def default_crop(spark, sf_dir):
    p = views.picks(spark, sf_dir).withColumn("q", dec.target_ratio(F.col)).where("q is not null")
    box = dec.default_crop(F.col("width"), F.col("height"), F.col("q"))
    return p.select("file_id", *[(F.round(box[n], 6) + 0.0).alias(a) for n, a in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))])


_SCALE = """coalesce(exact_width::DOUBLE / width, exact_height::DOUBLE / height, CASE WHEN greatest(1.0, coalesce(min_width, 0)::DOUBLE / width, coalesce(min_height, 0)::DOUBLE / height) > 1
  THEN greatest(1.0, coalesce(min_width, 0)::DOUBLE / width, coalesce(min_height, 0)::DOUBLE / height)
  ELSE least(1.0, coalesce(max_width::DOUBLE, 'inf'::DOUBLE) / width, coalesce(max_height::DOUBLE, 'inf'::DOUBLE) / height) END)"""


@query(o.with_views(f"SELECT file_id, round({_SCALE}, 9) AS scale FROM picks", *o.BASE))
def required_scale(spark, sf_dir):
    return views.picks(spark, sf_dir).select("file_id", F.round(dec.required_scale(F.col("width"), F.col("height"), F.col), 9).alias("scale"))


@query(o.with_views(
    f"""SELECT file_id, CASE WHEN error IS NULL THEN fw::BIGINT END AS w, CASE WHEN error IS NULL THEN fh::BIGINT END AS h, error FROM (
    SELECT *, CASE WHEN {o.BAD_RATIO} THEN 'needs-crop' WHEN scale > 1.0001 THEN 'needs-upscale'
      WHEN fw > max_width OR fh > max_height OR fw < min_width OR fh < min_height THEN 'rules-conflict' END AS error FROM (
    SELECT *, coalesce(exact_width, greatest(1, floor(width * scale + 0.5))) AS fw, coalesce(exact_height, greatest(1, floor(height * scale + 0.5))) AS fh FROM (
    SELECT *, greatest(coalesce(exact_width::DOUBLE / width, exact_height::DOUBLE / height, least(1.0, coalesce(max_width::DOUBLE, 'inf'::DOUBLE) / width, coalesce(max_height::DOUBLE, 'inf'::DOUBLE) / height)),
      coalesce(min_width, 0)::DOUBLE / width, coalesce(min_height, 0)::DOUBLE / height) AS scale FROM picks)))""", *o.BASE,
))
def target_dims(spark, sf_dir):
    t = dec.target_dimensions(F.col("width"), F.col("height"), F.col, allow_upscale=False)
    return views.picks(spark, sf_dir).select("file_id", t["width"].alias("w"), t["height"].alias("h"), t["error"].alias("error"))


@query(o.with_views(
    f"""SELECT file_id, CASE WHEN g.guess = output THEN name WHEN output IS NULL THEN NULL ELSE
      regexp_replace(name, '\\.[^.]*$', '') || e.exts[1] END AS new_name
    FROM chosen JOIN (SELECT file_id AS id, d.format AS guess FROM files LEFT JOIN dim d ON list_contains(d.exts, lower(regexp_extract(name, '\\.[^.]+$')))) g ON id = file_id
    LEFT JOIN dim e ON e.format = output""", *o.BASE, o.RATED, o.ISSUES, o.DECIDED.split(",\n  scaled")[0],
))
def output_name(spark, sf_dir):
    out = dec.choose_output(views.facts, F.col)
    return views.picks(spark, sf_dir).withColumn("out", out).select("file_id", F.when(F.col("out").isNotNull(), dec.output_name(F.col("name"), F.col("out"))).alias("new_name"))


@query(o.with_views(
    """SELECT file_id, greatest(1, floor(width * s + 0.5))::BIGINT AS w, greatest(1, floor(height * s + 0.5))::BIGINT AS h FROM (
    SELECT *, least(greatest(1.0, 1024.0::DOUBLE / greatest(width, height), coalesce(exact_width, min_width, 0)::DOUBLE / width, coalesce(exact_height, min_height, 0)::DOUBLE / height),
      coalesce(max_width::DOUBLE, 'inf'::DOUBLE) / width, coalesce(max_height::DOUBLE, 'inf'::DOUBLE) / height, 4096.0::DOUBLE / greatest(width, height)) AS s FROM picks)""", *o.BASE,
))
def svg_size(spark, sf_dir):
    s = dec.svg_size(F.col("width"), F.col("height"), F.col)
    return views.picks(spark, sf_dir).select("file_id", s["width"].alias("w"), s["height"].alias("h"))


@query(o.with_views(
    """SELECT file_id, greatest(1, floor(width * s))::BIGINT AS w, greatest(1, floor(height * s))::BIGINT AS h FROM (
    SELECT file_id, width, height, least(1.0, sqrt(4000000.0::DOUBLE / (width::DOUBLE * height)), 3000.0::DOUBLE / greatest(width, height)) AS s FROM files)""", o.FILES,
))
def working_size(spark, sf_dir):
    s = dec.working_size(F.col("width"), F.col("height"), 4_000_000, 3_000)
    return views.files(spark, sf_dir).select("file_id", s["width"].alias("w"), s["height"].alias("h"))


@query(o.with_views(
    """SELECT file_id, round((pw - width * s) / 2, 4) AS x, round((ph - height * s) / 2, 4) AS y, round(width * s, 4) AS w, round(height * s, 4) AS h FROM (
    SELECT *, least(0.75::DOUBLE, (pw - 56) / width, (ph - 56) / height) AS s FROM (SELECT file_id, width::DOUBLE AS width, height::DOUBLE AS height,
      CASE WHEN width > height THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS pw, CASE WHEN width > height THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS ph FROM files))""", o.FILES,
))
def a4_box(spark, sf_dir):
    box = dec.a4_box(F.col("width"), F.col("height"))
    return views.files(spark, sf_dir).select("file_id", *[F.round(box[n], 4).alias(a) for n, a in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))])


@query(o.with_views(
    """SELECT file_id, CASE WHEN width * 10 > 32767 OR height * 10 > 32767 OR width * height * 100 > 250000000 THEN 'too-large-to-process' END AS decode_error,
    CASE WHEN bytes * 1000 > 5368709120 THEN 'too-large-to-process' END AS size_error, (30000 + ceil(bytes::DOUBLE * 1000 / 1073741824 * 60000))::BIGINT AS budget_ms FROM files""", o.FILES,
))
def limits_check(spark, sf_dir):
    w, h, b = F.col("width") * 10, F.col("height") * 10, F.col("bytes") * 1000
    return views.files(spark, sf_dir).select(
        "file_id", dec.dimension_error(w, h, dec.MAX_DECODE_SIDE, dec.MAX_DECODE_PIXELS).alias("decode_error"),
        dec.file_size_error(b).alias("size_error"), dec.processing_ms(b).alias("budget_ms"),
    )


# joins, sets, ranks


#: Columns of a field's rules; fields that agree in all of them take the same files.
RULES = ("taken", "max_bytes", "min_bytes", "min_width", "min_height", "max_width", "max_height", "exact_width", "exact_height", "aspect_ratio", "dpi")


@query(o.with_views(
    "SELECT field_id, count(*) AS n FROM issued WHERE len(issues) = 0 GROUP BY field_id",
    o.DIM, o.FILES, o.FIELDS, o.PICKS.replace("ON field_id = (file_id * 31) % (SELECT count(*) FROM part)", "ON true"), o.RATED, o.ISSUES,
))
def accepting_fields(spark, sf_dir):
    """How many files each field takes as they are, by all its rules. Files that agree in what rules look at are counted
    first, and fields that agree in their rules are one; these meet by the format, not in a cross join, and dealt out by
    salt, so that no format is a hot task."""
    facts = ["format", "bytes", "width", "height", "dpi"]
    files = views.files(spark, sf_dir).groupBy(*facts).agg(F.count(F.lit(1)).alias("n"))
    fields = views.fields(spark, sf_dir)
    rule_sets = fields.groupBy(*RULES).agg(F.min("field_id").alias("rules_of"))
    salts = 16
    names = F.array_compact(F.array(*[F.when(reg.format_allowed(f.name, F.col("taken")), F.lit(f.name)) for f in reg.FORMATS]))
    wanted = rule_sets.withColumn("format", F.explode(names)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    offered = files.withColumn("salt", (F.xxhash64("bytes", "width", "height") % salts + salts) % salts).withColumnRenamed("dpi", "file_dpi")
    fits = F.size(dec.issues(views.facts, F.col)) == 0
    counts = wanted.join(offered, ["format", "salt"]).where(fits).groupBy("rules_of").agg(F.sum("n").alias("n"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"r.{c}")) for c in RULES]
    owners = fields.alias("f").join(rule_sets.alias("r"), same).select("f.field_id", "r.rules_of")
    return owners.join(counts, "rules_of").select("field_id", "n")


def _field_formats(spark, sf_dir, taken: bool) -> DataFrame:
    """(field_id, format) of the formats that a field takes or does not take: a semi or anti join with the 16 rows of the
    dimension, as tests of the field's bits."""
    fits = lambda f: reg.format_allowed(f.name, F.col("taken")) == F.lit(taken)
    names = F.array_compact(F.array(*[F.when(fits(f), F.lit(f.name)) for f in reg.FORMATS]))
    return views.fields(spark, sf_dir).select("field_id", F.explode(names).alias("format"))


@query(o.with_views(_PAIRS.format(not_=""), o.DIM, o.FIELDS))
def semi_formats(spark, sf_dir):
    return _field_formats(spark, sf_dir, True)


@query(o.with_views(_PAIRS.format(not_="NOT "), o.DIM, o.FIELDS))
def anti_formats(spark, sf_dir):
    return _field_formats(spark, sf_dir, False)


@query(o.with_views(_PAIRS.format(not_="NOT ") + f" AND {_CONVERTIBLE}", o.DIM, o.FIELDS))
def convertible_formats(spark, sf_dir):
    """Of the formats that a field does not take, those that can become one it takes."""
    refused = _field_formats(spark, sf_dir, False).join(views.fields(spark, sf_dir).select("field_id", "taken"), "field_id")
    return refused.where(reg.can_become(F.col("format"), F.col("taken"))).select("field_id", "format")


@query("""SELECT page_id FROM pages WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages WHERE page_id % 9 = 0) p
    WHERE p.host = regexp_extract(pages.url, '^[a-z]+://([^/:?#]+)', 1))""")
def paused_hosts(spark, sf_dir):
    """Pages whose host is not paused: an anti-join on the host name."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"))
    paused = pages.where("page_id % 9 = 0").select("host").distinct()
    return pages.join(paused, "host", "left_anti").select("page_id")


@query(o.with_views(
    """SELECT d.file_id, coalesce(CASE WHEN action = 'AUTO_FIX' THEN 'fixed_' || d.file_id END, d.name) AS delivered, action = 'AUTO_FIX' AS prepared FROM decided d""", *_DECIDED
))
def outer_results(spark, sf_dir):
    """Originals left-joined to results: a file without a result passes unchanged."""
    decided = _decided(spark, sf_dir)
    results = decided.where("d.action = 'AUTO_FIX'").select("file_id", F.concat(F.lit("fixed_"), "file_id").alias("result"))
    return views.files(spark, sf_dir).join(results, "file_id", "left").select("file_id", F.coalesce("result", "name").alias("delivered"), F.col("result").isNotNull().alias("prepared"))


@query("""SELECT user_id AS owner, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_choice(spark, sf_dir):
    """The newest event of each owner, by a partial aggregate (no sort of an owner's events)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("user_id").alias("owner")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e")).select("owner", "e.event_id", "e.event_type")


@query(o.with_views(
    "SELECT owner, event_id, code, n FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, event_id DESC) AS n FROM outcomes) WHERE n <= 20", o.OUTCOMES
))
def top20_problems(spark, sf_dir):
    recent = Window.partitionBy("owner").orderBy(F.desc("ts"), F.desc("event_id"))
    return views.outcomes(spark, sf_dir).withColumn("n", F.row_number().over(recent)).where("n <= 20").select("owner", "event_id", "code", "n")


@query(o.with_views(
    f"""SELECT field_id, count(*) AS n, sum(bytes)::BIGINT AS bytes, count(*) <= 12 AND sum(bytes) <= 21474836480 AS within, bool_or({_NEEDS_WORK}) AS any_work,
    arg_min(file_id, -bytes * 100000000 + file_id) AS largest FROM rated GROUP BY field_id""", *o.BASE, o.RATED
))
def selection_guard(spark, sf_dir):
    """Per field: number and size of the files, whether both are within limits, whether any might need work, and the largest (the first of equals)."""
    return _guessed(spark, sf_dir).groupBy("field_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), ((F.count(F.lit(1)) <= 12) & (F.sum("bytes") <= 20 * 1024**3)).alias("within"),
        F.bool_or(dec.might_need_work(F.col("guess"), F.col("bytes"), F.col)).alias("any_work"), F.max(F.struct("bytes", -F.col("file_id"), "file_id"))["file_id"].alias("largest"),
    )


# text forms and stored records


def _tenths(b: str, unit: int) -> str:
    """Bytes in units with one decimal in SQL, by the same exact arithmetic: on which side of the tie the quotient lies."""
    y = f"(({b}::DOUBLE / {unit} - floor({b}::DOUBLE / {unit})) * 4)"
    tie, total = f"(({b} // {unit // 10}) % 10 * 2 + 1)", f"({y} * 4 + {y})"
    tenths = f"({b} // {unit // 10} + CASE WHEN {total} > {tie} OR ({total} = {tie} AND {y} - ({total} - {y} * 4) >= 0) THEN 1 ELSE 0 END)"
    return f"regexp_replace(({tenths} // 10) || '.' || ({tenths} % 10), '\\.0$', '')"


def _bytes_text(b: str) -> str:
    return f"""CASE WHEN {b} < 1000 THEN {b} || ' B' WHEN {b} < 999500 THEN floor({b} / 1000.0 + 0.5)::BIGINT || ' KB'
    WHEN {b} < 999950000 THEN {_tenths(b, 10**6)} || ' MB' ELSE {_tenths(b, 10**9)} || ' GB' END"""


@query(o.with_views(
    f"""SELECT file_id, {_bytes_text('b')} AS size FROM (SELECT file_id, CASE file_id % 4 WHEN 0 THEN bytes // 1000 WHEN 1 THEN bytes WHEN 2 THEN bytes // 50000 * 50000 ELSE bytes * 1009 END AS b FROM files)""", o.FILES,
))
def format_bytes(spark, sf_dir):
    i = F.col("file_id")
    b = F.when(i % 4 == 0, F.expr("bytes div 1000")).when(i % 4 == 1, F.col("bytes")).when(i % 4 == 2, F.expr("bytes div 50000 * 50000")).otherwise(F.col("bytes") * 1009)
    return views.files(spark, sf_dir).select("file_id", fmt.format_bytes(b).alias("size"))


@query(o.with_views("SELECT event_id, CASE WHEN bytes <= 0 THEN 0 ELSE (floor(bytes / p + 0.5) * p)::BIGINT END AS bytes FROM (SELECT *, pow(10, greatest(len(bytes::VARCHAR) - 2, 0)) AS p FROM outcomes)", o.OUTCOMES))
def round_bytes(spark, sf_dir):
    return views.outcomes(spark, sf_dir).select("event_id", fmt.round_bytes(F.col("bytes")).alias("bytes"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN trim(TRAILING '.' FROM trim(TRAILING '0' FROM printf('%.2f', p_size / 4.0))) || ' × ' || trim(TRAILING '.' FROM trim(TRAILING '0' FROM printf('%.2f', (p_size + 1) / 4.0))) || ' in'
    ELSE trim(TRAILING '.' FROM trim(TRAILING '0' FROM printf('%.2f', (p_size + 10) / 10.0))) || ' × ' || trim(TRAILING '.' FROM trim(TRAILING '0' FROM printf('%.2f', (p_size + 23) / 10.0))) || ' cm' END AS size
    FROM part""")
def print_size(spark, sf_dir):
    s, even = F.col("p_size").cast("double"), F.col("p_partkey") % 2 == 0
    w, h = F.when(even, s / 4 * 25.4).otherwise(s + 10), F.when(even, (s + 1) / 4 * 25.4).otherwise(s + 23)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", fmt.print_size(w, h).alias("size"))


_LABELS = "MAP {" + ", ".join(f"'{x}': '{f.label}'" for f in reg.FORMATS for x in (*f.mimes, *f.exts)) + "}"
_SIDES = "coalesce({0}_width::VARCHAR, 'any') || ' × ' || coalesce({0}_height::VARCHAR, 'any')"


@query(o.with_views(
    f"""SELECT field_id, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' · ') ELSE 'no rules found' END AS summary FROM (SELECT field_id, list_filter([
      CASE WHEN len(labels) > 0 THEN array_to_string(labels, ', ') WHEN list_contains(accepted_mimes, 'image/*') THEN 'any image' END,
      CASE WHEN min_bytes > 0 AND max_bytes > 0 THEN {_bytes_text('min_bytes')} || '–' || {_bytes_text('max_bytes')} WHEN max_bytes > 0 THEN 'max ' || {_bytes_text('max_bytes')}
        WHEN min_bytes > 0 THEN 'at least ' || {_bytes_text('min_bytes')} END,
      CASE WHEN exact_width > 0 OR exact_height > 0 THEN {_SIDES.format('exact')} END, CASE WHEN min_width > 0 OR min_height > 0 THEN 'at least ' || {_SIDES.format('min')} END,
      CASE WHEN max_width > 0 OR max_height > 0 THEN 'at most ' || {_SIDES.format('max')} END,
      CASE WHEN aspect_ratio > 0 AND NOT coalesce(exact_width > 0, false) THEN 'shape ' || aspect_ratio::DECIMAL(9,3)::DOUBLE::VARCHAR.regexp_replace('\\.0$', '') || ' : 1' END,
      CASE WHEN dpi > 0 THEN dpi || ' DPI' END], lambda x: x IS NOT NULL) AS parts
    FROM (SELECT *, list_filter(list_transform(list_concat(accepted_mimes, accepted_exts), lambda x: {_LABELS}[x]), lambda x: x IS NOT NULL) AS named,
      list_filter(named, lambda x, i: list_position(named, x) = i) AS labels FROM fields))""", o.FIELDS,
))
def rules_summary(spark, sf_dir):
    return views.fields(spark, sf_dir).select("field_id", fmt.rules_summary(F.col).alias("summary"))


@query(o.with_views(
    f"""SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M') AS at, code, regexp_replace(props, '[\\x00-\\x1f\\x7f]', ' ', 'g')[1:160] AS rules
    , CASE WHEN event_id % 17 < 16 THEN {o._NAMES}[event_id % 17 + 1] END AS format, CASE WHEN bytes <= 0 THEN 0 ELSE (floor(bytes / p + 0.5) * p)::BIGINT END AS bytes
    FROM (SELECT o.*, e.props, pow(10, greatest(len(bytes::VARCHAR) - 2, 0)) AS p FROM outcomes o JOIN events e USING (event_id)) WHERE code IN {tuple(fmt.ERROR_CODES)} AND event_id % 19 <> 3""", o.OUTCOMES,
))
def problem_normalise(spark, sf_dir):
    """Problem records as they are kept: known codes and formats only, minutes in UTC, rounded bytes, printable rules."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    i = F.col("event_id")
    # some records come with a code or a format that nothing knows
    rows = views.outcomes(spark, sf_dir).join(e, "event_id").withColumn("code", F.when(i % 19 == 3, "no-such-code").otherwise(F.col("code")))
    name = views._pick(views.NAMES, i % 17)
    return rows.where(F.col("code").isin(*fmt.ERROR_CODES)).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("at"), "code", fmt.printable(F.col("props")).alias("rules"),
        F.when(name.isin(*reg.BY_NAME), name).alias("format"), fmt.round_bytes(F.col("bytes")).alias("bytes"),
    )


@query(o.with_views(
    f"SELECT owner, count(*) AS lists, bool_and(len(list_filter(changes, lambda c: c NOT IN {o.COUNTED})) = 0) AND count(*) <= 32 AS valid FROM outcomes GROUP BY owner", o.OUTCOMES,
))
def change_list_valid(spark, sf_dir):
    """Whether an owner's outcomes would pass as one message: a boolean aggregate, no list is collected."""
    bad = F.exists("changes", lambda c: ~c.isin(*fmt.COUNTED_CHANGES))
    return views.outcomes(spark, sf_dir).groupBy("owner").agg(F.count(F.lit(1)).alias("lists"), (F.bool_and(~bad) & (F.count(F.lit(1)) <= 32)).alias("valid"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice * 1e9 < 1e12 AND p_retailprice > 0 THEN p_retailprice END AS max_bytes, CASE WHEN p_size - 10 > 0 THEN (p_size - 10)::DOUBLE END AS dpi FROM part""")
def rules_sanitise(spark, sf_dir):
    price = F.col("p_retailprice")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", F.when(fmt.sanitized_number(price * 1e9).isNotNull(), price).alias("max_bytes"), fmt.sanitized_number((F.col("p_size") - 10).cast("double")).alias("dpi")
    )


# rules from prose


@query(o.with_views(
    """SELECT field_id, max_bytes::DOUBLE AS max_bytes, min_bytes::DOUBLE AS min_bytes, CASE WHEN field_id % 8 <> 5 THEN min_width::DOUBLE END AS min_width, min_height::DOUBLE AS min_height,
    CASE WHEN field_id % 8 <> 1 THEN max_width::DOUBLE END AS max_width, max_height::DOUBLE AS max_height, exact_width::DOUBLE AS exact_width, exact_height::DOUBLE AS exact_height,
    CASE WHEN field_id % 8 = 4 THEN aspect_ratio END AS aspect_ratio, dpi::DOUBLE AS dpi FROM fields""", o.FIELDS,
))
def rules_from_text(spark, sf_dir):
    """Rules read back from sentences; the SQL selects the numbers that the sentences were made from."""
    found = rules_text.evidence(views.fields(spark, sf_dir).select("field_id", "sentence"), "field_id", "sentence")
    rules = rules_text.resolve(found, "field_id")
    names = ("max_bytes", "min_bytes", "min_width", "min_height", "max_width", "max_height", "exact_width", "exact_height", "aspect_ratio", "dpi")
    return rules.select("field_id", *names)


@query("SELECT doc_id, CAST(NULL AS VARCHAR) AS rule, CAST(NULL AS DOUBLE) AS num FROM documents WHERE false")
def no_rules_in_prose(spark, sf_dir):
    """Ordinary prose states no trusted size, shape or DPI rule; the documents are read to their ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = rules_text.evidence(docs, "doc_id", chars=None)
    return found.where((F.col("confidence") >= rules_text.TRUSTED) & (F.col("rule") != "accepted_mimes")).select("doc_id", "rule", "num")


@query(o.with_views(
    """SELECT field_id, array_to_string(list_distinct_kept, ',') AS mimes, array_to_string(accepted_exts, ',') AS exts FROM (SELECT *, accepted_mimes AS list_distinct_kept FROM fields)""", o.FIELDS
))
def accept_parse(spark, sf_dir):
    """The accept attribute, written in capitals with repeats and junk, read back to its tokens."""
    f = views.fields(spark, sf_dir)
    text = F.concat_ws(" , ", F.transform("accepted_mimes", lambda m: F.upper(m)), F.col("accepted_exts"), F.col("accepted_exts"), F.lit("junk"), F.lit(""))
    parsed = rules_text.parse_accept(text)
    return f.select("field_id", _join(parsed["mimes"]).alias("mimes"), _join(parsed["exts"]).alias("exts"))


# bookkeeping


_FIXES = f"SELECT unnest(changes) AS change FROM outcomes WHERE len(list_filter(changes, lambda c: c NOT IN {o.COUNTED})) = 0"


@query(o.with_views(f"SELECT change, count(*) AS n FROM ({_FIXES}) GROUP BY change", o.OUTCOMES))
def fix_counts(spark, sf_dir):
    return bookkeeping.fix_counts(views.outcomes(spark, sf_dir))


@query(o.with_views(f"SELECT change, count(*) AS n FROM ({_FIXES}) GROUP BY GROUPING SETS ((change), ())", o.OUTCOMES))
def fix_counts_rollup(spark, sf_dir):
    return bookkeeping.counted(views.outcomes(spark, sf_dir)).rollup("change").agg(F.count(F.lit(1)).alias("n"))


@query(o.with_views(
    """SELECT owner, count(*) AS files, count(*) FILTER (WHERE event_id % 3 <> 0) AS prepared, CASE WHEN count(*) FILTER (WHERE event_id % 3 <> 0) = 0 THEN 'fails-open'
    WHEN count(*) FILTER (WHERE event_id % 3 = 0) > 0 THEN 'partial' ELSE 'prepared' END AS outcome FROM outcomes GROUP BY owner""", o.OUTCOMES,
))
def partial_failure(spark, sf_dir):
    ok = F.col("event_id") % 3 != 0
    n, good = F.count(F.lit(1)), F.count_if(ok)
    return views.outcomes(spark, sf_dir).groupBy("owner").agg(
        n.alias("files"), good.alias("prepared"), F.when(good == 0, "fails-open").when(good < n, "partial").otherwise("prepared").alias("outcome")
    )


@query("""SELECT user_id AS owner, session_no, min(ts) AS first_ts, count(*) AS n FROM (SELECT *, sum(new_session) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new_session FROM events)) GROUP BY ALL""")
def idle_sessions(spark, sf_dir):
    """Sessions that end when an owner is idle for an hour."""
    return bookkeeping.idle_sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), 3600)


@query("""WITH RECURSIVE visits AS MATERIALIZED (SELECT user_id AS owner, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    passed AS (SELECT DISTINCT owner, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS last, CAST(NULL AS BIGINT) AS event_id, false AS ok FROM visits
      UNION ALL SELECT v.owner, v.n, CASE WHEN p.last IS NULL OR v.ts >= p.last + INTERVAL 6 HOUR THEN v.ts ELSE p.last END, v.event_id, p.last IS NULL OR v.ts >= p.last + INTERVAL 6 HOUR
      FROM passed p JOIN visits v ON v.owner = p.owner AND v.n = p.n + 1)
    SELECT owner, last AS ts, event_id FROM passed WHERE ok""")
def warm_throttle(spark, sf_dir):
    """Warm-ups: after one, none for six hours; the pause starts anew with each that is let through."""
    return bookkeeping.throttled(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("owner"), "ts", "event_id"), 6 * 3600)


# pages, bytes, streams


@query("""SELECT page_id, 0 AS field_no, (CASE WHEN page_id % 6 = 2 THEN (100 + page_id % 900) * 1000 ELSE (100 + page_id % 900) * 1000 END)::DOUBLE AS max_bytes,
    CASE page_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg,image/png' ELSE '' END AS mimes FROM pages WHERE page_id % 6 < 5
    UNION ALL SELECT page_id, 1, 7000000::DOUBLE, '' FROM pages WHERE page_id % 6 = 4""")
def html_rules(spark, sf_dir):
    """Rules of the upload fields in pages; the SQL has the numbers that the forms were made with."""
    rules = html.html_rules(views.field_pages(spark, sf_dir))
    return rules.select("page_id", "field_no", "max_bytes", _join("accepted_mimes").alias("mimes"))


@query("SELECT page_id FROM pages WHERE false")
def no_fields_in_raw_pages(spark, sf_dir):
    return html.html_fields(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")).select("page_id")


@query(o.with_views("SELECT file_id, ['png', 'gif', 'bmp', 'webp'][file_id % 4 + 1] AS format, width, height, CASE file_id % 4 WHEN 0 THEN file_id % 8 = 0 WHEN 3 THEN true ELSE false END AS alpha, false AS animated FROM files", o.FILES))
def header_facts(spark, sf_dir):
    facts = headers.header_facts(F.col("content"))
    return views.header_bytes(spark, sf_dir).select("file_id", facts.alias("f")).select("file_id", "f.format", "f.width", "f.height", "f.alpha", "f.animated")


@query(o.with_views("SELECT file_id, ['heic', 'avif', 'jxl', 'jxl'][file_id % 4 + 1] AS format, width, height, file_id % 4 = 1 AS animated FROM files", o.FILES))
def coded_header_facts(spark, sf_dir):
    """HEIF and AVIF files with a preview's size before the picture's, and JPEG XL bare and in a container."""
    b = views.coded_header_bytes(spark, sf_dir).withColumn("format", headers.detect(F.col("content")))
    return b.select("file_id", "format", coded_headers.coded_facts(F.col("format"), F.col("content")).alias("f")).select("file_id", "format", "f.width", "f.height", "f.animated")


@query(o.with_views("SELECT file_id, ['png', 'gif', 'bmp', 'webp'][file_id % 4 + 1] AS format FROM files", o.FILES))
def magic_detect(spark, sf_dir):
    return views.header_bytes(spark, sf_dir).select("file_id", headers.detect(F.col("content")).alias("format"))


@query(SQL["fix_counts"])
def fix_counts_stream(spark, sf_dir):
    return feeds.drain(feeds.running_counts(feeds.events_stream(spark, sf_dir)), "complete", spark)


@query("SELECT user_id AS owner, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def session_supersede(spark, sf_dir):
    """The state after a stream whose deliveries are not in the order of time: each owner's last word."""
    out = feeds.fed(_mixed_deliveries(spark, sf_dir), feeds.newest_selection, "update")
    return feeds.last_given(out).select("owner", "event_id")


def _mixed_deliveries(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return [e.where(F.col("event_id") % 3 == k) for k in (2, 0, 1)]


@query(o.with_views("SELECT owner, event_id, code FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, event_id DESC) AS n FROM outcomes) WHERE n <= 20", o.OUTCOMES))
def problem_ring(spark, sf_dir):
    """The state after a stream whose deliveries are not in the order of time: each owner's ring."""
    out = feeds.fed(_mixed_deliveries(spark, sf_dir), feeds.problem_ring, "update")
    return feeds.last_given(out).select("owner", "event_id", "code")


# pixels and sheets


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT)) AS b FROM embeddings),
    p AS (SELECT x.vec_id, x.b AS a, y.b AS c FROM v x JOIN v y ON y.vec_id = x.vec_id + 1),
    s AS (SELECT vec_id, list_sum(a)::BIGINT AS sa, list_sum(c)::BIGINT AS sc, list_sum(list_transform(a, lambda x: x * x))::BIGINT AS qa, list_sum(list_transform(c, lambda x: x * x))::BIGINT AS qc,
      list_sum(list_transform(list_zip(a, c), lambda z: z[1] * z[2]))::BIGINT AS ac FROM p)
    SELECT vec_id, round((2 * sa / 64.0::DOUBLE * (sc / 64.0::DOUBLE) + 6.5025::DOUBLE) * (2 * (64 * ac - sa * sc) / 4032.0::DOUBLE + 58.5225::DOUBLE)
      / (((sa / 64.0::DOUBLE) * (sa / 64.0::DOUBLE) + (sc / 64.0::DOUBLE) * (sc / 64.0::DOUBLE) + 6.5025::DOUBLE)
       * ((64 * qa - sa * sa) / 4032.0::DOUBLE + (64 * qc - sc * sc) / 4032.0::DOUBLE + 58.5225::DOUBLE)), 6) + 0.0 AS ssim FROM s""")
def ssim_blocks(spark, sf_dir):
    """Structural similarity of neighbouring 8 x 8 blocks, from exact integer sums with native array functions."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("a"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("c")), "vec_id")
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    both = lambda x, y: total(F.zip_with(x, y, lambda u, v: u * v))
    s = p.select("vec_id", total("a").alias("sa"), total("c").alias("sc"), both("a", "a").alias("qa"), both("c", "c").alias("qc"), both("a", "c").alias("ac"))
    ma, mc = F.col("sa") / 64.0, F.col("sc") / 64.0
    var = lambda q, t: (64 * F.col(q) - F.col(t) * F.col(t)) / 4032.0
    cov = (64 * F.col("ac") - F.col("sa") * F.col("sc")) / 4032.0
    value = (2 * ma * mc + 6.5025) * (2 * cov + 58.5225) / ((ma * ma + mc * mc + 6.5025) * (var("qa", "sa") + var("qc", "sc") + 58.5225))
    return s.select("vec_id", (F.round(value, 6) + 0.0).alias("ssim"))


# A model of file sizes: a file's bytes by a factor of 1/64 to 16, falling with pixels^0.9 and, in a lossy format, with quality^3.
def _modelled(spark, sf_dir) -> DataFrame:
    writable, lossy = [f.name for f in FORMATS if f.alpha is not None], [f.name for f in FORMATS if f.lossy]
    full = F.greatest(F.lit(1), F.floor(F.col("bytes") * F.pow(F.lit(4.0), F.col("file_id") % 6 - 3)))
    p = views.picks(spark, sf_dir).where(F.col("format").isin(writable))
    return p.withColumns({"full": full, "lossy": F.col("format").isin(lossy)})


def _model_size(width: Column, height: Column, quality: Column) -> Column:
    share = F.pow((width * height) / (F.col("width") * F.col("height")), F.lit(0.9))
    return (F.floor(F.col("full") * share * F.when(F.col("lossy"), F.pow(quality / 0.92, F.lit(3.0))).otherwise(1.0)) + 1).cast("long")


def _size_sql(w: str, h: str, q: str) -> str:
    return f"(floor(full_bytes * pow(({w}) * ({h}) / (width * height), 0.9) * CASE WHEN lossy THEN pow(({q}) / 0.92::DOUBLE, 3) ELSE 1.0::DOUBLE END) + 1)::BIGINT"


_MODELLED = f"""modelled AS (SELECT file_id, width, height, lossy, max_bytes, min_bytes, greatest(1, floor(bytes * pow(4, file_id % 6 - 3)))::DOUBLE AS full_bytes, file_id % 3 <> 0 AS may_shrink,
    coalesce(floor(max_bytes * 0.96::DOUBLE), pow(2, 62)) AS room, {o.SAFE_MIN} AS safe_min,
    least(1.0::DOUBLE, greatest(1 / least(width, height), coalesce(min_width, 0) / width, coalesce(min_height, 0) / height)) AS least_scale FROM rated WHERE writable)"""
_PROBED = f"""probed AS (SELECT *, {_size_sql("width", "height", "0.92::DOUBLE")} AS usual, {_size_sql("width", "height", "0.4::DOUBLE")} AS lowest, {_size_sql("width", "height", "1.0::DOUBLE")} AS highest,
    CASE WHEN min_bytes IS NULL THEN 0 ELSE least(safe_min, room) END AS minimum FROM modelled)"""
_BY_QUALITY = f"""by_quality AS (
    SELECT file_id, width, height, lossy, full_bytes, room, 0 AS n, 0.4::DOUBLE AS low, lowest AS low_bytes, 0.92::DOUBLE AS high, usual AS high_bytes FROM probed WHERE lossy AND usual > room AND lowest <= room
    UNION ALL
    SELECT file_id, width, height, lossy, full_bytes, room, n + 1, CASE WHEN size <= room THEN q ELSE low END, CASE WHEN size <= room THEN size ELSE low_bytes END,
      CASE WHEN size <= room THEN high ELSE q END, CASE WHEN size <= room THEN high_bytes ELSE size END
    FROM (SELECT *, {_size_sql("width", "height", "q")} AS size FROM (
      SELECT *, least(high - edge, greatest(low + edge, low + least(1.0::DOUBLE, greatest(0.0::DOUBLE, share)) * (high - low))) AS q FROM (
        SELECT *, least(0.01::DOUBLE, (high - low) / 4) AS edge,
          CASE WHEN ln(high_bytes) - ln(low_bytes) > 0 THEN (ln(room * 0.995::DOUBLE) - ln(low_bytes)) / (ln(high_bytes) - ln(low_bytes)) ELSE 0.5 END AS share
        FROM by_quality WHERE n < 4 AND high - low > 0.01::DOUBLE))))"""
_W, _H = "greatest(1, floor(width * tried + 0.5::DOUBLE))", "greatest(1, floor(height * tried + 0.5::DOUBLE))"
_BY_SCALE = f"""to_shrink AS (SELECT *, CASE WHEN lossy THEN 0.6::DOUBLE ELSE 0.92::DOUBLE END AS q, CASE WHEN lossy THEN 2 ELSE 1 END AS before,
      CASE WHEN lossy THEN exp(ln(lowest) + (0.6::DOUBLE - 0.4::DOUBLE) / (0.92::DOUBLE - 0.4::DOUBLE) * (ln(usual) - ln(lowest))) ELSE usual::DOUBLE END AS at_full
    FROM probed WHERE may_shrink AND room > 0 AND usual > room AND (NOT lossy OR lowest > room)),
  by_scale AS (
    SELECT file_id, width, height, lossy, full_bytes, room, q, least_scale, 0 AS n, NULL::DOUBLE AS fit, NULL::BIGINT AS fit_bytes, 1.0::DOUBLE AS big, 1.0::DOUBLE AS last, at_full AS last_bytes, 1.8::DOUBLE AS exponent,
      least(0.98::DOUBLE, pow(room * 0.97::DOUBLE / at_full, 1 / 1.8::DOUBLE)) AS scale, true AS going FROM to_shrink
    UNION ALL
    SELECT file_id, width, height, lossy, full_bytes, room, q, least_scale, n + 1, fit2, fit_bytes2, big2, tried, size::DOUBLE, exponent2,
      CASE WHEN aim >= big2 THEN sqrt(coalesce(fit2, least_scale) * big2) WHEN aim <= fit2 THEN sqrt(fit2 * big2) ELSE aim END,
      NOT (size > room AND tried <= least_scale) AND NOT coalesce(big2 / fit2 - 1 <= 0.02::DOUBLE, false) AND NOT (size <= room AND aim / tried - 1 <= 0.02::DOUBLE)
    FROM (SELECT *, tried * pow(room * 0.985::DOUBLE / size, 1 / exponent2) AS aim FROM (
      SELECT *, CASE WHEN size <= room AND (fit IS NULL OR tried > fit) THEN tried ELSE fit END AS fit2, CASE WHEN size <= room AND (fit IS NULL OR tried > fit) THEN size ELSE fit_bytes END AS fit_bytes2,
        CASE WHEN size > room AND tried < big THEN tried ELSE big END AS big2,
        CASE WHEN tried <> last AND size <> last_bytes THEN least(2.5::DOUBLE, greatest(1.0::DOUBLE, ln(size / last_bytes) / ln(tried / last))) ELSE exponent END AS exponent2
      FROM (SELECT *, {_size_sql(_W, _H, "q")} AS size FROM (SELECT *, greatest(least_scale, scale) AS tried FROM by_scale WHERE going AND n < 7)))))"""
_FITTED = f"""SELECT file_id, CASE WHEN error IS NULL THEN w END::BIGINT AS width, CASE WHEN error IS NULL THEN h END::BIGINT AS height, CASE WHEN error IS NULL THEN round(quality, 6) END AS quality,
    CASE WHEN error IS NULL THEN size END::BIGINT AS bytes, CASE WHEN error IS NULL THEN filler END::BIGINT AS filler, encodes::INT AS encodes, error FROM (
  SELECT file_id, NULL AS w, NULL AS h, NULL::DOUBLE AS quality, NULL AS size, NULL AS filler, 0 AS encodes, 'rules-conflict' AS error FROM probed WHERE room <= 0
  UNION ALL SELECT file_id, width, height, CASE WHEN usual < minimum AND lossy AND highest <= room THEN 1.0 ELSE 0.92 END, CASE WHEN usual >= minimum THEN usual ELSE greatest(CASE WHEN lossy AND highest <= room THEN highest ELSE usual END, minimum) END,
    CASE WHEN usual >= minimum THEN 0 ELSE greatest(0, minimum - CASE WHEN lossy AND highest <= room THEN highest ELSE usual END) END,
    CASE WHEN usual < minimum AND lossy AND minimum >= min_bytes THEN 2 ELSE 1 END, CASE WHEN usual < minimum AND minimum < min_bytes THEN 'target-unreachable' END FROM probed WHERE room > 0 AND usual <= room
  UNION ALL SELECT file_id, width, height, low, low_bytes, 0, n + 2, NULL FROM by_quality WHERE room > 0 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC) = 1
  UNION ALL SELECT * FROM (SELECT s.file_id, greatest(1, floor(s.width * fit + 0.5)), greatest(1, floor(s.height * fit + 0.5)), s.q, fit_bytes, 0, n + t.before, CASE WHEN fit IS NULL THEN 'target-unreachable' END
    FROM by_scale s JOIN to_shrink t USING (file_id) QUALIFY row_number() OVER (PARTITION BY s.file_id ORDER BY n DESC) = 1)
  UNION ALL SELECT file_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN lossy THEN 2 ELSE 1 END, 'target-unreachable' FROM probed WHERE NOT may_shrink AND room > 0 AND usual > room AND (NOT lossy OR lowest > room))"""


@query(o.with_views(_FITTED, *o.BASE, o.RATED, _MODELLED, _PROBED, _BY_QUALITY, _BY_SCALE).replace("WITH ", "WITH RECURSIVE ", 1))
def size_search_model(spark, sf_dir):
    """The finest save of each picture within its field's limits of bytes, on a model of file sizes; the SQL keeps a frontier of open searches."""
    get = F.col
    found = size_search.fit_to_bytes(_model_size, get("width"), get("height"), get("max_bytes"), get("min_bytes"), get("lossy"), get("file_id") % 3 != 0, get("min_width"), get("min_height"))
    out = _modelled(spark, sf_dir).select("file_id", found.alias("f"))
    return out.select("file_id", "f.width", "f.height", F.round("f.quality", 6).alias("quality"), "f.bytes", "f.filler", "f.encodes", "f.error")


_FINER = f"""finer AS (SELECT file_id, width, height, lossy, full_bytes, room, 0 AS n, 0.92::DOUBLE AS low, 1.0::DOUBLE AS high, NULL::BIGINT AS bytes FROM modelled WHERE lossy AND max_bytes IS NOT NULL
    UNION ALL SELECT file_id, width, height, lossy, full_bytes, room, n + 1, CASE WHEN size <= room THEN q ELSE low END, CASE WHEN size <= room THEN high ELSE q END, CASE WHEN size <= room THEN size ELSE bytes END
    FROM (SELECT *, {_size_sql("width", "height", "q")} AS size FROM (SELECT *, (low + high) / 2 AS q FROM finer WHERE n < 3)))"""


@query(o.with_views("SELECT file_id, CASE WHEN bytes IS NOT NULL THEN round(low, 6) END AS quality, bytes FROM finer WHERE n = 3", *o.BASE, o.RATED, _MODELLED, _FINER).replace("WITH ", "WITH RECURSIVE ", 1))
def finer_quality(spark, sf_dir):
    """The finest save above the usual quality that a limit leaves room for."""
    m = _modelled(spark, sf_dir).where("lossy and max_bytes is not null")
    found = size_search.finer_quality(_model_size, F.col("width"), F.col("height"), size_search.byte_target(F.col("max_bytes")))
    return m.select("file_id", found.alias("f")).select("file_id", F.round("f.quality", 6).alias("quality"), "f.bytes")


@query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN value END AS number, CASE event_id % 5 WHEN 3 THEN '0' || event_id WHEN 4 THEN '+' || event_id END AS text FROM events")
def csv_typing(spark, sf_dir):
    """Cells that are plain numbers become numbers; leading zeros and plus signs stay text."""
    i = F.col("event_id")
    cell = F.when(i % 5 < 3, F.col("value").cast("string")).when(i % 5 == 3, F.concat(F.lit("0"), i)).otherwise(F.concat(F.lit("+"), i))
    typed = sheets.number_or_text(cell)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", typed["number"].alias("number"), typed["text"].alias("text"))


@query(o.with_views(
    f"""SELECT file_id, CASE WHEN taken OR t IS NULL THEN 'pass' WHEN t = 'csv' AND file_id % 4 > 1 THEN 'confirm' ELSE 'convert' END AS choice FROM (
    SELECT *, CASE WHEN {o.one_allowed('xlsx')} AND format <> 'xlsx' THEN 'xlsx' WHEN {o.one_allowed('csv')} AND format <> 'csv' THEN 'csv' END AS t FROM rated WHERE kind = 'sheet')""", *o.BASE, o.RATED,
))
def sheet_choice(spark, sf_dir):
    target = F.get(reg.conversion_targets(F.col("format"), F.col("taken")), F.lit(0))
    p = views.picks(spark, sf_dir).where(reg.is_sheet(F.col("format")))
    return p.select("file_id", sheets.sheet_choice(F.col("file_id") % 4, dec.allowed(F.col("format"), F.col), target).alias("choice"))


# crops, options, settings, reports


@query(o.with_views(
    """SELECT file_id, CASE WHEN e IS NULL THEN l::BIGINT END AS x, CASE WHEN e IS NULL THEN t::BIGINT END AS y, CASE WHEN e IS NULL THEN cw::BIGINT END AS w, CASE WHEN e IS NULL THEN ch::BIGINT END AS h, e AS error
    FROM (SELECT *, CASE WHEN cw < 1 OR ch < 1 THEN 'needs-crop' END AS e FROM (SELECT file_id, l, t, least(width - l, floor(width / 2.0 + 0.5)) AS cw, least(height - t, floor(height / 3.0 + 0.5)) AS ch
    FROM (SELECT *, greatest(0, floor(width * (file_id % 7) / 6.0 - 20 + 0.5)) AS l, greatest(0, floor(height * (file_id % 5) / 4.0 - 3 + 0.5)) AS t FROM files)))""", o.FILES,
))
def crop_norm(spark, sf_dir):
    w, h, i = F.col("width").cast("double"), F.col("height").cast("double"), F.col("file_id")
    c = dec.normalize_crop(w * (i % 7) / 6 - 20, h * (i % 5) / 4 - 3, w / 2, h / 3, w, h)
    return views.files(spark, sf_dir).select("file_id", *[c[n].alias(a) for n, a in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"), ("error", "error"))])


@query(o.with_views(
    """SELECT file_id, round(greatest(0.0, least(width / 2.0 - bw / 2, width - bw)), 6) AS x, round(greatest(0.0, least(height / 2.0 - bw / 2, height - bw)), 6) AS y, round(bw, 6) AS w
    FROM (SELECT *, least(width, height)::DOUBLE / greatest(1.0::DOUBLE, least(4.0::DOUBLE, (file_id % 11)::DOUBLE / 2)) AS bw FROM files)""", o.FILES,
))
def crop_zoom(spark, sf_dir):
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    base = dec.default_crop(w, h, F.lit(1.0))
    z = dec.zoom_crop(base, w, h, (F.col("file_id") % 11).cast("double") / 2, base)
    return views.files(spark, sf_dir).select("file_id", F.round(z["x"], 6).alias("x"), F.round(z["y"], 6).alias("y"), F.round(z["width"], 6).alias("w"))


@query(o.with_views(
    """SELECT file_id, CASE WHEN format IN ('jpeg', 'png', 'webp', 'avif', 'gif', 'tiff', 'bmp', 'ico', 'pdf', 'csv', 'xlsx') THEN format ELSE 'jpeg' END AS output,
    CASE WHEN file_id % 2 = 0 AND file_id // 2 BETWEEN 1 AND 999 THEN file_id // 2 END AS sheet, file_id % 3 = 0 AS allow FROM files""", o.FILES,
))
def options_sanitise(spark, sf_dir):
    i = F.col("file_id")
    flag = F.when(i % 3 == 0, "true").when(i % 3 == 1, "yes")
    return views.files(spark, sf_dir).select("file_id", dec.sanitized_options(F.col("format"), i / 2, flag).alias("s")).select("file_id", "s.*")


@query("""SELECT user_id AS owner, array_to_string(list_sort(list(DISTINCT lower(event_type) || '.example')), ',') AS hosts FROM events GROUP BY user_id""")
def settings_normalise(spark, sf_dir):
    """Host lists: lower case, each once. Hosts are made distinct per owner before they are gathered (five names at most here)."""
    hosts = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("owner"), F.concat(F.upper("event_type"), F.lit(".Example")).alias("host")).distinct()
    listed = hosts.groupBy("owner").agg(F.collect_list("host").alias("hosts"))
    return listed.select("owner", _join(F.array_sort(fmt.normalized_hosts(F.concat("hosts", F.array(F.lit("bad host!")))))).alias("hosts"))


@query(o.with_views(
    """SELECT owner, n, strftime(ts, '%Y-%m-%d %H:%M') || ' ' || code AS line FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, event_id DESC) AS n FROM outcomes
    WHERE code NOT IN ('unsupported-format', 'cancelled')) WHERE n <= 20""", o.OUTCOMES,
))
def problem_report(spark, sf_dir):
    """Lines of the report, newest first, without the codes that are kept quiet."""
    recent = Window.partitionBy("owner").orderBy(F.desc("ts"), F.desc("event_id"))
    loud = views.outcomes(spark, sf_dir).where(~F.col("code").isin("unsupported-format", "cancelled"))
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm"), "code")
    return loud.withColumn("n", F.row_number().over(recent)).where("n <= 20").select("owner", "n", line.alias("line"))


@query(o.with_views("SELECT field_id, outputs[1] AS first_choice FROM (SELECT field_id, " + o.outputs() + " AS outputs FROM fields)", o.FIELDS))
def first_preference(spark, sf_dir):
    return views.fields(spark, sf_dir).select("field_id", F.get(reg.allowed_outputs(F.col("taken")), F.lit(0)).alias("first_choice"))


# prepared files


@query(o.with_views("SELECT file_id, CASE WHEN 1 + file_id % 8 >= 5 THEN height ELSE width END AS w, CASE WHEN 1 + file_id % 8 >= 5 THEN width ELSE height END AS h FROM files", o.FILES))
def display_size(spark, sf_dir):
    size = prep.display_size(F.col("width"), F.col("height"), 1 + F.col("file_id") % 8)
    return views.files(spark, sf_dir).select("file_id", size["width"].alias("w"), size["height"].alias("h"))


@query(o.with_views(
    """SELECT file_id, CASE WHEN file_id % 3 = 0 THEN least(coalesce(max_width, 256), 256) ELSE max_width END AS max_width,
    CASE WHEN file_id % 3 = 0 THEN least(coalesce(max_height, 256), 256) ELSE max_height END AS max_height, min_width FROM picks""", *o.BASE,
))
def icon_limit(spark, sf_dir):
    r = prep.with_icon_limit(F.col, F.when(F.col("file_id") % 3 == 0, "ico").otherwise("jpeg"))
    return views.picks(spark, sf_dir).select("file_id", *[r(n).alias(n) for n in ("max_width", "max_height", "min_width")])


@query(o.with_views(
    """SELECT file_id, CASE WHEN sw < width AND room < 1 AND file_id % 4 > 0 THEN greatest(1, floor(width * room)) ELSE width END::BIGINT AS w,
    CASE WHEN sw < width AND room < 1 AND file_id % 4 > 0 THEN greatest(1, floor(height * room)) ELSE height END::BIGINT AS h FROM (
    SELECT *, least(sw::DOUBLE / width, sh::DOUBLE / height) AS room FROM (SELECT file_id, width, height, width // 2 + 700 AS sw, height // 2 + 500 AS sh FROM files))""", o.FILES,
))
def within_room(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    sw, sh = F.expr("width div 2 + 700"), F.expr("height div 2 + 500")
    size = prep.within_room(w, h, sw, sh, sw / w, F.col("file_id") % 4 == 0)
    return views.files(spark, sf_dir).select("file_id", size["width"].alias("w"), size["height"].alias("h"))


@query(o.with_views(
    """SELECT file_id, CASE WHEN format IN ('csv', 'xlsx', 'xls') THEN 'sheet' WHEN format = 'pdf' AND file_id % 3 = 0 THEN 'pdf-shrink' WHEN format = 'pdf' AND file_id % 2 = 0 THEN 'unsupported-format'
    WHEN format = 'pdf' THEN 'pdf-page' WHEN file_id % 3 = 0 THEN 'image-pdf' ELSE 'image' END AS route FROM files""", o.FILES,
))
def explicit_route(spark, sf_dir):
    i = F.col("file_id")
    return views.files(spark, sf_dir).select("file_id", prep.explicit_route(F.col("format"), F.when(i % 3 == 0, "pdf").otherwise("jpeg"), i % 2 != 0).alias("route"))


@query(o.with_views(
    """SELECT file_id, CASE WHEN action IN ('AUTO_FIX', 'USER_CONFIRMATION') THEN coalesce(output, 'jpeg') ELSE 'jpeg' END AS output,
    action = 'USER_CONFIRMATION' AND list_contains(wants, 'transparency') AS transparency, action = 'USER_CONFIRMATION' AND list_contains(wants, 'animation') AS animation, true AS upscale FROM decided""",
    *_DECIDED,
))
def transform_options(spark, sf_dir):
    t = prep.transform_options(F.col("d.output_format"), F.col("d.consents"))
    names = {"output": "output", "allow_transparency_loss": "transparency", "allow_animation_loss": "animation", "allow_upscale": "upscale"}
    return _decided(spark, sf_dir).select("file_id", *[t[n].alias(a) for n, a in names.items()])


@query(o.with_views(
    f"""SELECT file_id, array_to_string(list_filter([CASE WHEN format <> output THEN 'converted' END, CASE WHEN {o.BAD_RATIO} THEN 'cropped' END, CASE WHEN width > 2000 THEN 'resized' END,
    CASE WHEN bytes > max_bytes THEN 'compressed' END, CASE WHEN bytes < {o.SAFE_MIN} THEN 'raised-to-minimum' END, CASE WHEN transparent AND output IN ('jpeg', 'bmp') THEN 'background-added' END,
    CASE WHEN animated THEN 'first-frame' END, CASE WHEN pages > 1 THEN 'first-page' END, CASE WHEN file_id % 8 <> 0 THEN 'orientation-applied' END,
    CASE WHEN dpi > 0 AND file_dpi IS DISTINCT FROM dpi THEN 'dpi-set' END], lambda x: x IS NOT NULL), ',') AS changes FROM chosen WHERE output IS NOT NULL""",
    *o.BASE, o.RATED, o.ISSUES, o.DECIDED.split(",\n  scaled")[0],
))
def transform_changes(spark, sf_dir):
    p = views.picks(spark, sf_dir).withColumns({"output": dec.choose_output(views.facts, F.col), "orientation": 1 + F.col("file_id") % 8}).where("output is not null")
    cropped = ~dec.same_ratio(F.col("width").cast("double"), F.col("height").cast("double"), dec.target_ratio(F.col))
    return p.select("file_id", _join(prep.changes(views.facts, F.col, F.col("output"), cropped, F.col("width") > 2000)).alias("changes"))


@query("""SELECT page_id, page_id % 11 <> 0 AND NOT list_has_any(['embed3.example', 'embed5.example'], ['own' || page_id % 5 || '.example', lower('EMBED' || page_id % 7 || '.Example')]) AS active FROM pages""")
def active_pages(spark, sf_dir):
    """Pages that are served: neither their own host nor the host of the page around them is paused."""
    i = F.col("page_id")
    hosts = F.array(F.concat(F.lit("own"), i % 5, F.lit(".example")), F.concat(F.lit("EMBED"), i % 7, F.lit(".Example")))
    paused = F.array(F.lit("embed3.example"), F.lit("embed5.example"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", prep.is_active_on(i % 11 != 0, paused, hosts).alias("active"))


@query(o.with_views(
    """SELECT field_id, count(*) AS n, min(q) AS low, max(q) AS high, CASE WHEN bool_or(sheet) THEN 'files' ELSE 'images' END AS noun, coalesce(min(q) < 97, false) AS noticeable,
    CASE WHEN min(called) = max(called) THEN min(called) ELSE 'file' END AS called FROM (
    SELECT field_id, format IN ('csv', 'xlsx', 'xls') AS sheet, CASE WHEN format NOT IN ('csv', 'xlsx', 'xls') THEN 60 + file_id % 41 END AS q,
      CASE WHEN format = 'pdf' THEN 'PDF' WHEN format IN ('csv', 'xlsx', 'xls', 'unknown') THEN 'file' ELSE 'image' END AS called FROM picks) GROUP BY field_id""", *o.BASE,
))
def quality_range(spark, sf_dir):
    """What is said about the files of a selection: their number, the range of quality, and what they are called."""
    quality = prep.quality_range(F.col("format"), 60 + F.col("file_id") % 41)
    called = prep.noun_of_all(F.col("format"))
    return views.picks(spark, sf_dir).groupBy("field_id").agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in quality.items()], called.alias("called"))


@query("""SELECT doc_id AS file_id, md5(to_base64(encode(coalesce(text, '')))) AS data, true AS same, doc_id % 3 > 0 AS sendable FROM documents""")
def message_files(spark, sf_dir):
    """Files as messages: their bytes in base64 and back, and whether a message may hold them."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("content", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    data, long = F.translate(F.base64("content"), "\r\n", ""), F.col("doc_id") % 3 == 0  # without the line ends of mail
    name = F.when(long, F.repeat(F.lit("n"), 1025)).otherwise(F.lit("photo.jpg"))
    return d.select(F.col("doc_id").alias("file_id"), F.md5(data).alias("data"), (F.unbase64(data) == F.col("content")).alias("same"), prep.sendable(name, F.lit("image/jpeg"), data).alias("sendable"))


@query("""SELECT event_id, coalesce(lag(files) OVER (PARTITION BY owner ORDER BY ts, event_id) = files, false) AS same FROM (
    SELECT event_id, ts, user_id AS owner, CASE WHEN event_id % 2 = 0 THEN [event_id % 3] ELSE [event_id % 3, 7] END AS files FROM events)""")
def same_selection(spark, sf_dir):
    """Whether an owner's selection has the same files in the same order as the one before it."""
    i = F.col("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("files", F.when(i % 2 == 0, F.array(i % 3)).otherwise(F.array(i % 3, F.lit(7).cast("long"))))
    before = F.lag("files").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", F.coalesce(before == F.col("files"), F.lit(False)).alias("same"))


@query(o.with_views("SELECT field_id, string_agg('fixed_' || file_id, ',' ORDER BY file_id) AS delivered FROM picks GROUP BY field_id", *o.BASE))
def delivered_in_order(spark, sf_dir):
    """Results of a selection in the order of its files, whatever the order they were made in; a selection has few files."""
    made = views.picks(spark, sf_dir).select("field_id", "file_id", F.concat(F.lit("fixed_"), "file_id").alias("name"))
    ordered = F.array_sort(F.collect_list(F.struct("file_id", "name")))
    return made.groupBy("field_id").agg(_join(F.transform(ordered, lambda x: x["name"])).alias("delivered"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS enabled, CASE event_id % 5 WHEN 1 THEN false ELSE true END AS ask FROM events""")
def settings_flags(spark, sf_dir):
    """Stored settings field by field: what is no boolean counts as its default."""
    value = F.get(F.array(*[F.lit(v) for v in ("true", "false", '"false"', "0", "null")]), (F.col("event_id") % 5).cast("int"))
    stored = F.parse_json(F.concat(F.lit('{"enabled": '), value, F.lit(', "ask": '), value, F.lit("}")))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", stored.alias("s"))
    return e.select("event_id", prep.flag(F.col("s"), "enabled", True).alias("enabled"), prep.flag(F.col("s"), "ask", True).alias("ask"))


@query(o.with_views("SELECT owner, sum(len(changes))::BIGINT AS fixes, sum(len(changes)) >= 10 AND owner % 2 = 0 AS ask FROM outcomes GROUP BY owner", o.OUTCOMES))
def rating_suggestions(spark, sf_dir):
    per_owner = views.outcomes(spark, sf_dir).groupBy("owner").agg(F.sum(F.size("changes")).alias("fixes"))
    return per_owner.select("owner", "fixes", prep.suggest_rating(F.col("fixes"), F.col("owner") % 2 != 0).alias("ask"))


@query(o.with_views("SELECT format, format IN ('heic', 'heif', 'avif', 'jxl', 'svg') AS settled_late, format IN ('jpeg', 'png', 'tiff', 'bmp') AS streamed FROM dim", o.DIM))
def format_flags(spark, sf_dir):
    f = F.col("format")
    return reg.dim_format(spark).select("format", f.isin(*prep.SETTLED_BY_DECODER).alias("settled_late"), f.isin(*prep.STREAMED).alias("streamed"))


# stores and feeds


def _outcome_parts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return feeds.deliveries(e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))))


@query(SQL["fix_counts"])
def fix_counts_store(spark, sf_dir):
    """Counts that a stream adds to a stored table, batch by batch, each once."""
    table = store.VersionedTable(spark, shared_folder(spark, "counts"), store.COUNTS)
    feeds.fed(_outcome_parts(spark, sf_dir), views.outcomes_of, sink=lambda rows, batch: store.add_counts(table, "stream", batch, bookkeeping.fix_counts(rows)))
    return table.read()


@query(o.with_views("SELECT epoch_us(ts) AS us, event_id, owner, code FROM outcomes ORDER BY ts DESC, event_id DESC LIMIT 20", o.OUTCOMES))
def problem_log(spark, sf_dir):
    """The stored log of the latest 20 problems, appended to by a stream."""
    table = store.VersionedTable(spark, shared_folder(spark, "problems"), store.PROBLEMS)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    feeds.fed(_outcome_parts(spark, sf_dir), views.outcomes_of, sink=lambda rows, batch: store.append_problems(table, "stream", batch, rows.withColumn("us", micros), fmt.MAX_PROBLEMS))
    return table.read()


@query(f"""WITH {page_events.SETTINGS_FEED} SELECT v.event_id, v.host, coalesce(c.enabled, true) AS enabled, coalesce(c.ask, true) AS ask, c.event_id AS version
    FROM visits v ASOF LEFT JOIN changes c ON v.host = c.host AND v.us >= c.us""")
def settings_in_force(spark, sf_dir):
    """The settings of its host that were in force at each event; defaults before the first change."""
    events, changes = page_events.settings_feed(spark, sf_dir)
    found = asof.as_of(events, changes.withColumnRenamed("event_id", "version"), "host", "us", ["version", "enabled", "ask"])
    default = lambda c: F.coalesce(c, F.lit(True)).alias(c)
    return found.select("event_id", "host", default("enabled"), default("ask"), "version")


_LISTED = "SELECT doc_id // 200 AS k, string_agg(doc_id || ' ' || n_chars || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1"


@query(f"""SELECT k, CAST(strlen(body) AS BIGINT) AS size, md5(substring(body, 1, 4096)) AS head, strlen(body) <= 4096 AS whole FROM ({_LISTED})""")
def file_heads(spark, sf_dir):
    """Size and first 4096 bytes of files, of which no more is read."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars").withColumn("k", F.floor(F.col("doc_id") / 200).cast("long"))
    folder = shared_folder(spark, "listed")
    d.repartition("k").sortWithinPartitions("k", "doc_id").select("k", F.concat_ws(" ", "doc_id", "n_chars").alias("line")).write.partitionBy("k").text(folder)
    found = heads.read_heads(spark, folder, 4096, "part-*")
    return found.select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("long").alias("k"), "size", F.md5("head").alias("head"), (F.length("head") == F.col("size")).alias("whole"))
