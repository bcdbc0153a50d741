"""The SQL side of the conformance queries: views and building blocks as DuckDB text."""

from __future__ import annotations

from fitgate.functions.formatting import CHANGES, COUNTED_CHANGES, ERROR_CODES
from fitgate.functions.registry import FORMATS, OUTPUTS, PHOTO_ORDER, TRANSPARENT_ORDER


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


_DIM = ", ".join(
    f"({i}, '{f.name}', '{f.label}', {sql_list(f.mimes)}, {sql_list(f.exts)}, '{f.kind}', {f.alpha is not None}, {bool(f.alpha)}, {bool(f.lossy)}, "
    f"{sql_list([m for g in FORMATS if g.name == f.name or g.name in f.family for m in g.mimes])}, {sql_list([e for g in FORMATS if g.name == f.name or g.name in f.family for e in g.exts])})"
    for i, f in enumerate(FORMATS)
)
DIM = f"dim(ord, format, label, mimes, exts, kind, writable, alpha, lossy, family_mimes, family_exts) AS (VALUES {_DIM})"
_NAMES = sql_list([*(f.name for f in FORMATS), "unknown"])
_EXTS = sql_list([*(f.exts[-1] for f in FORMATS), ".bin"])
_MIMES = sql_list([*(f.mimes[0] for f in FORMATS), "application/octet-stream"])
FILES = f"""files AS (SELECT doc_id AS file_id,
  'file_' || doc_id || CASE WHEN doc_id % 7 = 0 THEN upper({_EXTS}[doc_id % 17 + 1]) ELSE {_EXTS}[doc_id % 17 + 1] END AS name,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 AND doc_id % 17 < 16 THEN upper({_MIMES}[doc_id % 17 + 1]) ELSE {_MIMES}[doc_id % 17 + 1] END AS mime,
  {_NAMES}[doc_id % 17 + 1] AS format, n_chars * 997 AS bytes, 16 + (doc_id * 7919) % 6000 AS width, 16 + (doc_id * 104729) % 6000 AS height,
  doc_id % 11 = 0 AS transparent, doc_id % 13 = 0 AS animated, CASE WHEN doc_id % 17 = 12 THEN 1 + doc_id % 3 END AS pages,
  CASE doc_id % 4 WHEN 1 THEN 72 WHEN 2 THEN 200 WHEN 3 THEN 300 END AS file_dpi FROM documents)"""
FIELDS = """fields AS (SELECT p_partkey AS field_id,
  CASE p_partkey % 8 WHEN 0 THEN ['image/jpeg', 'image/png'] WHEN 1 THEN ['image/*'] WHEN 2 THEN ['image/jpeg'] WHEN 3 THEN ['application/pdf']
    WHEN 4 THEN ['image/png', 'image/webp'] WHEN 5 THEN ['image/jpeg'] ELSE []::VARCHAR[] END AS accepted_mimes,
  CASE p_partkey % 8 WHEN 2 THEN ['.jpg'] WHEN 4 THEN ['.heif'] WHEN 6 THEN ['.csv', '.xlsx'] ELSE []::VARCHAR[] END AS accepted_exts,
  CASE p_partkey % 8 WHEN 0 THEN p_size * 100000 WHEN 1 THEN p_size * 1000000 WHEN 3 THEN p_size * 50000 WHEN 5 THEN p_size * 2000000 END AS max_bytes,
  CASE p_partkey % 8 WHEN 5 THEN p_size * 1000 WHEN 4 THEN 20000 END AS min_bytes,
  CASE p_partkey % 8 WHEN 1 THEN 100 + p_size * 10 WHEN 5 THEN 200 END AS min_width,
  CASE p_partkey % 8 WHEN 1 THEN 100 + p_size * 5 END AS min_height,
  CASE p_partkey % 8 WHEN 1 THEN 3000 + p_size WHEN 7 THEN 1000 + p_size * 10 END AS max_width,
  CASE p_partkey % 8 WHEN 7 THEN 800 + p_size * 10 END AS max_height,
  CASE p_partkey % 8 WHEN 2 THEN 600 END AS exact_width, CASE p_partkey % 8 WHEN 2 THEN 400 + p_size END AS exact_height,
  CASE WHEN p_partkey % 8 = 4 THEN 1.0::DOUBLE WHEN p_partkey % 8 = 7 AND p_partkey % 3 = 0 THEN 1.5::DOUBLE END AS aspect_ratio,
  CASE p_partkey % 8 WHEN 5 THEN 300 END AS dpi FROM part)"""
PICKS = "picks AS (SELECT * FROM files JOIN fields ON field_id = (file_id * 31) % (SELECT count(*) FROM part))"


def allowed(fmt: str, kind: str, mimes: str, exts: str, r: str = "") -> str:
    """Condition that a format with these properties is taken by a field's lists."""
    return (
        f"(len({r}accepted_mimes) + len({r}accepted_exts) = 0 OR ({fmt} <> 'unknown' AND (list_contains({r}accepted_mimes, '*/*') OR (list_contains({r}accepted_mimes, 'image/*') AND {kind} = 'image')"
        f" OR list_has_any({r}accepted_mimes, {mimes}) OR list_has_any({r}accepted_exts, {exts}))))"
    )


_ONE = {f.name: f for f in FORMATS}


def one_allowed(name: str) -> str:
    f = _ONE[name]
    group = [f, *(_ONE[g] for g in f.family)]
    return allowed(f"'{name}'", f"'{f.kind}'", sql_list([m for g in group for m in g.mimes]), sql_list([e for g in group for e in g.exts]))


def outputs(order=OUTPUTS) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {one_allowed(n)} THEN '{n}' END" for n in order) + "], lambda x: x IS NOT NULL)"


SAFE_MIN = "ceil(min_bytes::DOUBLE * CASE WHEN min_bytes < 1000000 THEN 1.024::DOUBLE ELSE 1.048576::DOUBLE END)"
RATIO = "coalesce(aspect_ratio, exact_width::DOUBLE / exact_height)"
BAD_RATIO = f"abs(width - height * {RATIO}) > greatest(1.0, {RATIO})"
HAS_DIMS = "coalesce(min_width, min_height, max_width, max_height, exact_width, exact_height, aspect_ratio) IS NOT NULL"
#: picks with everything that decisions need, one column at a time.
RATED = f"""rated AS (SELECT p.*, coalesce(d.kind, 'none') AS kind, coalesce(d.writable, false) AS writable, coalesce(d.lossy, false) AS lossy,
    {allowed('p.format', 'd.kind', 'd.family_mimes', 'd.family_exts')} AS taken,
    {outputs()} AS outputs, {outputs(PHOTO_ORDER)} AS photo, {outputs(TRANSPARENT_ORDER)} AS clear, {outputs([n for n in PHOTO_ORDER if _ONE[n].lossy])} AS photo_lossy
  FROM picks p LEFT JOIN dim d ON p.format = d.format)"""
ISSUES = f"""issued AS (SELECT *, CASE WHEN format = 'unknown' OR NOT bytes > 0 THEN ['unknown'] ELSE list_filter([
    CASE WHEN NOT coalesce(taken, false) THEN 'unsupported-format' END,
    CASE WHEN dpi > 0 AND format IN ('jpeg', 'png') AND file_dpi IS DISTINCT FROM dpi THEN 'wrong-dpi' END,
    CASE WHEN bytes > max_bytes THEN 'too-large' END, CASE WHEN bytes < {SAFE_MIN} THEN 'too-small-file' END,
    CASE WHEN width < min_width OR height < min_height THEN 'too-small-dimensions' END,
    CASE WHEN width > max_width OR height > max_height THEN 'too-large-dimensions' END,
    CASE WHEN width <> exact_width OR height <> exact_height THEN 'exact-dimensions-required' END,
    CASE WHEN {BAD_RATIO} THEN 'wrong-aspect-ratio' END], lambda x: x IS NOT NULL) END AS issues FROM rated)"""
DECIDED = f"""chosen AS (SELECT *, CASE WHEN writable AND taken AND bytes > max_bytes AND NOT lossy AND NOT transparent THEN coalesce(photo_lossy[1], format)
      WHEN writable AND taken THEN format WHEN transparent THEN clear[1] ELSE photo[1] END AS output,
    {BAD_RATIO} AS crops, least(width, height * {RATIO}) AS crop_w FROM issued),
  scaled AS (SELECT *, CASE WHEN crops THEN crop_w ELSE width END AS w, CASE WHEN crops THEN crop_w / {RATIO} ELSE height END AS h FROM chosen),
  asked AS (SELECT *, list_filter([CASE WHEN crops THEN 'crop' END, CASE WHEN pages > 1 THEN 'page' END,
      CASE WHEN transparent AND output IN ('jpeg', 'bmp') THEN 'transparency' END, CASE WHEN animated THEN 'animation' END,
      CASE WHEN output = 'gif' AND format <> 'gif' THEN 'palette' END,
      CASE WHEN coalesce(exact_width / w, exact_height / h, greatest(1.0, coalesce(min_width, 0) / w, coalesce(min_height, 0) / h)) > 1.1 THEN 'upscale' END],
      lambda x: x IS NOT NULL) AS wants FROM scaled),
  decided AS (SELECT *, CASE WHEN len(issues) = 0 THEN 'PASS_THROUGH' WHEN list_contains(issues, 'unknown') OR output IS NULL THEN 'UNSAFE_TO_FIX'
      WHEN len(wants) > 0 THEN 'USER_CONFIRMATION' ELSE 'AUTO_FIX' END AS action FROM asked)"""
OUTCOMES = f"""outcomes AS (SELECT event_id, ts, user_id AS owner, event_type,
    list_filter([{', '.join(f"CASE WHEN (event_id >> {k}) % 2 = 1 THEN '{c}' END" for k, c in enumerate(CHANGES[:8]))}], lambda x: x IS NOT NULL) AS changes,
    {sql_list(ERROR_CODES)}[event_id % 16 + 1] AS code, cast(trunc(value * 1000000) AS BIGINT) AS bytes FROM events)"""
COUNTED = "('" + "', '".join(COUNTED_CHANGES) + "')"


def with_views(select: str, *views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + select


BASE = (DIM, FILES, FIELDS, PICKS)
