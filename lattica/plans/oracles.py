"""SQL that gives the rows of the data-quality queries, for comparison over whole tables."""

from __future__ import annotations



def _resolved(path: str, base: str | None = None) -> str:
    clean = lambda p: f"replace(regexp_replace({p}, '^\\s+|\\s+$', '', 'g'), '\\', '/')"
    own = clean(path)
    full = own if base is None else f"(CASE WHEN {own}[1]='/' THEN {own} ELSE {clean(base)}||'/'||{own} END)"
    return f"list_reduce(list_prepend('', string_split({full}, '/')), lambda acc, s: CASE WHEN s IN ('','.') THEN acc WHEN s='..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc||'/'||s END)"


_ENTRY_NAME = r"""regexp_extract(replace(trim(regexp_extract(regexp_replace(replace(replace(image_to_transform, chr(13)||chr(10), chr(10)), chr(13), chr(10)), '^\s*image\s*:\s*', '', 'i'), '^(\S.*?\.[A-Za-z][A-Za-z0-9]{0,4}|\S+)(\s|$)', 1)), '\', '/'), '([^/]*)$', 1)"""

_REFS = f"""refs AS (
SELECT 'stos_files' AS source_table, stos_id AS record_id, 'control_image_full_path' AS field_name, {_resolved('control_image_full_path', 'stos_dir')} AS k, recorded_at AS at_ FROM stos_files WHERE trim(coalesce(control_image_full_path,''), ' '||chr(9)||chr(10)||chr(13))<>''
UNION SELECT 'stos_files', stos_id, 'mapped_image_full_path', {_resolved('mapped_image_full_path', 'stos_dir')}, recorded_at FROM stos_files WHERE trim(coalesce(mapped_image_full_path,''), ' '||chr(9)||chr(10)||chr(13))<>''
UNION SELECT 'stos_files', stos_id, 'control_mask_full_path', {_resolved('control_mask_full_path', 'stos_dir')}, recorded_at FROM stos_files WHERE trim(coalesce(control_mask_full_path,''), ' '||chr(9)||chr(10)||chr(13))<>''
UNION SELECT 'mosaic_tiles', entry_id, 'image_to_transform', {_resolved("tile_dir||'/'||" + _ENTRY_NAME)}, recorded_at FROM mosaic_tiles),
lives AS (SELECT DISTINCT {_resolved('image_full_path')} AS k, registered_at, deleted_at FROM images),
orphans AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM lives l WHERE l.k=r.k AND l.registered_at<=r.at_ AND (l.deleted_at IS NULL OR r.at_<l.deleted_at)))"""

_TILE = r"regexp_extract(lower(regexp_replace(replace(regexp_replace(output_file_full_path, '^\s+|\s+$', '', 'g'), '\', '/'), '/+', '/', 'g')), '([^/]+/[^/]+)$', 1)"
_CURRENT = f"""files AS (SELECT DISTINCT file_id, {_TILE} AS tile, n_bytes, content_crc, written_at FROM tileset_files),
cur AS (SELECT tile, string_split(tile,'/')[1] AS level, arg_max(struct_pack(f:=file_id, n:=n_bytes, c:=content_crc), row(written_at, file_id)) AS b FROM files WHERE n_bytes>0 GROUP BY tile),
placed AS (SELECT level, tile, b.f AS file_id, b.n AS n_bytes, b.c AS content_crc, (sum(b.n) OVER (PARTITION BY level ORDER BY tile) - b.n)::BIGINT AS byte_offset FROM cur)"""

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_FIELD = r'("(?:[^"]|"")*"|[^",]*)'


def _column(i: int) -> str:
    got = f"regexp_extract(l, '^{','.join([_FIELD] * i)}', {i})"
    return f"(CASE WHEN {got}[1]='\"' THEN replace(substr({got},2,length({got})-2),'\"\"','\"') ELSE {got} END)"

_TOKENS = rf"""raw AS (SELECT DISTINCT raw_id, regexp_replace(coalesce(line_text,''), '\r$', '') AS l FROM raw_records),
shape AS (SELECT raw_id, l, regexp_full_match(l, '(?s){_FIELD}(,{_FIELD})*') AS fine, length(regexp_replace(l,'"(?:[^"]|"")*"','','g'))-length(replace(regexp_replace(l,'"(?:[^"]|"")*"','','g'),',',''))+1 AS n, {_column(1)} AS kind, {_column(2)} AS id, {_column(4)} AS c4, {_column(5)} AS ds, {_column(6)} AS wh, {_column(7)} AS c7 FROM raw),
src AS (SELECT 'stos_files' AS source_table, stos_id AS record_id, transform_str AS t FROM stos_files UNION SELECT 'mosaic_tiles', entry_id,
 regexp_replace(regexp_replace(image_to_transform, '^\s*image\s*:\s*', '', 'i'), '^(\S.*?\.[A-Za-z][A-Za-z0-9]{{0,4}}|\S+)(\s|$)', '') FROM mosaic_tiles UNION SELECT 'raw_records', raw_id, CASE WHEN kind='stos' THEN c7 ELSE c4 END FROM shape WHERE fine AND (kind='stos' AND n=8 OR kind='mosaic' AND n=5)),
tok AS (SELECT source_table, record_id, list_filter(string_split_regex(coalesce(t,''), '\s+'), lambda x: x<>'') AS t FROM src),
pos AS (SELECT *, CASE WHEN list_position(t[3:],'fp')>0 THEN list_position(t[3:],'fp')+2 END AS f FROM tok)"""
_KINDS = "'LegendrePolynomialTransform_double_2_2_1','Rigid2DTransform_double_2_2','CenteredSimilarity2DTransform_double_2_2','GridTransform_double_2_2','MeshTransform_double_2_2'"

SQL = {
    "p1_found": f"WITH {_REFS} SELECT source_table, record_id, field_name FROM orphans",
    "p1_orphans_by_month": f"WITH {_REFS} SELECT source_table, field_name, strftime(at_, '%Y-%m') AS month, count(*) AS n_orphans FROM orphans GROUP BY ALL",
    "p3_found": rf"""WITH {_TOKENS}, formed AS (SELECT *, t[4:f-1] AS v, t[f+2:] AS p, CASE WHEN len(t)>=3 AND t[1] IN ({_KINDS}) AND t[2]='vp' AND regexp_full_match(t[3],'[0-9]+') AND f IS NOT NULL AND len(t)>f AND regexp_full_match(t[f+1],'[0-9]+') THEN 1 ELSE 0 END AS ok FROM pos),
val AS (SELECT *, list_transform(v, lambda x: CASE WHEN regexp_full_match(x,'{_NUMBER}') AND abs(x::DOUBLE)<1.79769e308 THEN x::DOUBLE END) AS nv, list_transform(p, lambda x: CASE WHEN regexp_full_match(x,'{_NUMBER}') AND abs(x::DOUBLE)<1.79769e308 THEN x::DOUBLE END) AS np FROM formed),
want AS (SELECT *, CASE t[1][1] WHEN 'L' THEN 4 WHEN 'R' THEN 2 WHEN 'C' THEN 0 WHEN 'G' THEN 7 ELSE 8 END AS wf, CASE t[1][1] WHEN 'L' THEN 6 WHEN 'R' THEN 3 WHEN 'C' THEN 6 WHEN 'G' THEN 2*(np[2]+1)*(np[3]+1) ELSE 4*np[8] END AS wv FROM val),
res AS (SELECT source_table, record_id, CASE WHEN ok=0 THEN 'invalid_value' WHEN t[3]::BIGINT<>len(v) OR t[f+1]::BIGINT<>len(p) OR len(p)<>wf OR coalesce(len(v)<>wv,false) THEN 'column_count' WHEN len(list_filter(nv||np, lambda x: x IS NULL))>0 THEN 'invalid_value' END AS reason FROM want),
own AS (SELECT raw_id, CASE WHEN NOT fine THEN 'quoting' WHEN kind NOT IN ('stos','mosaic') THEN 'invalid_value' WHEN n<>(CASE WHEN kind='stos' THEN 8 ELSE 5 END) THEN 'column_count' WHEN NOT regexp_full_match(id,'0*[1-9][0-9]*') OR (kind='stos' AND NOT (regexp_full_match(ds,'0*[1-9][0-9]*') AND regexp_full_match(wh,'0*[1-9][0-9]*\s+0*[1-9][0-9]*'))) THEN 'invalid_value' END AS reason FROM shape),
every AS (SELECT source_table, record_id, reason FROM res UNION ALL SELECT 'raw_records', raw_id, reason FROM own)
SELECT source_table, record_id, CASE min(CASE reason WHEN 'quoting' THEN 1 WHEN 'column_count' THEN 2 ELSE 3 END) WHEN 1 THEN 'quoting' WHEN 2 THEN 'column_count' ELSE 'invalid_value' END AS reason FROM every WHERE reason IS NOT NULL GROUP BY ALL""",
    "p4_found": f"WITH {_CURRENT} SELECT DISTINCT file_id FROM tileset_files WHERE file_id NOT IN (SELECT file_id FROM placed)",
    "p4_assignment": f"WITH {_CURRENT} SELECT level, byte_offset//134217728 AS file_no, byte_offset, tile, file_id, n_bytes, content_crc FROM placed",
    "p4_ranges": f"WITH {_CURRENT} SELECT level, byte_offset//134217728 AS file_no, min(tile) AS first_tile, max(tile) AS last_tile, count(*) AS n_tiles, sum(n_bytes)::BIGINT AS n_bytes FROM placed GROUP BY ALL",
}

#: Nanometres by spelling of a unit, as in the engine.
_UNITS = {**{w: 1 for w in ("nm", "nanometer", "nanometers", "nanometre", "nanometres", "nanometern")}, **{w: 1e3 for w in ("µm", "μm", "um", "micron", "microns", "micrometer", "micrometers", "micrometre", "micrometres", "mikrometer", "mikrometern")}, **{w: 1e6 for w in ("mm", "millimeter", "millimeters", "millimetre", "millimetres", "millimetern")}, **{w: 0 for w in ("px", "pix", "pixel", "pixels")}}
_ALT = "|".join(sorted(_UNITS, key=len, reverse=True))
_NUM = r"[+-]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][+-]?[0-9]+)?"


def _scale(word: str) -> str:
    return "(CASE " + " ".join(f"WHEN {word} IN ({', '.join(repr(w) for w, v in _UNITS.items() if v == k)}) THEN {float(k)}" for k in (1, 1e3, 1e6, 0)) + " END)"


def _unit_in(text: str) -> str:
    return _scale(f"regexp_extract(lower(coalesce({text},'')), '(?:^|[^\\p{{L}}_])({_ALT})(?:$|[^\\p{{L}}_])', 1)")


def _pixels(value: str, scale: str, full: str) -> str:
    return f"CASE WHEN {scale}>0 THEN {value}*{scale}/pixel_nm WHEN {full} THEN {value} ELSE {value}*ds END"


def _with_units(parse: str) -> str:
    """Rows of p5_found; ``parse`` gives the valid transforms of stos_files as ``parsed``."""
    frac = r"([0-9]+(?:[.,][0-9]+)?)"
    got = lambda p, i=1: f"try_cast(replace(regexp_extract(t, '{p}', {i}), ',', '.') AS DOUBLE)"
    ratio, level, power, percent, plain = rf"^{frac} ?[:/] ?{frac}$", r"^(?:level|lvl) ?([0-9]+)$", r"^2 ?\^ ?([0-9]+)$", rf"^{frac} ?%$", rf"^(?:ds|x)? ?{frac} ?x?$"
    coordinates = rf"(?:coordinates?|coords?|points?|units?|koordinaten)\b[^,;.]{{0,40}}?[^\p{{L}}_]({_ALT})(?:$|[^\p{{L}}_])"
    full = "regexp_matches(lower(coalesce({0},'')), 'full[ _-]*(?:res\\b|resolution)')"
    two = lambda v: f"CASE WHEN {v}>=1 AND pow(2,round(log2({v})))={v} THEN {v} END"
    return rf"""WITH {parse}, s AS (SELECT DISTINCT stos_id, stos_name, lower(trim(regexp_replace(coalesce(downsample,''),'\s+',' ','g'))) AS t, mapped_image_dim, pixel_nm, coord_unit, remark FROM stos_files),
v AS (SELECT *, CASE WHEN regexp_matches(t,'{level}') THEN pow(2,{got(level)}) WHEN regexp_matches(t,'{power}') THEN pow(2,{got(power)}) WHEN regexp_matches(t,'{percent}') THEN 100/{got(percent)} WHEN regexp_matches(t,'{ratio}') THEN CASE WHEN {got(ratio)}=1 THEN {got(ratio, 2)} WHEN {got(ratio, 2)}=1 THEN {got(ratio)} END
 WHEN regexp_matches(t,'{plain}') THEN CASE WHEN {got(plain)}<1 THEN 1/{got(plain)} ELSE {got(plain)} END END AS val, try_cast(nullif(regexp_extract(stos_name,'_([0-9]+)(?:\.[A-Za-z]+)?\s*$',1),'') AS DOUBLE) AS named FROM s),
q AS (SELECT *, coalesce({two('val')}, {two('named')}) AS ds, list_transform(regexp_extract_all(coalesce(mapped_image_dim,''),'{_NUM}'), lambda x: replace(x,',','.')::DOUBLE) AS dims, {_unit_in('mapped_image_dim')} AS d_scale, {full.format('mapped_image_dim')} AS d_full,
 coalesce({_unit_in('coord_unit')}, {_scale(f"regexp_extract(lower(coalesce(remark,'')), '{coordinates}', 1)")}) AS x_scale, {full.format('coord_unit')} AS x_full FROM v),
x AS (SELECT q.*, CASE transform_type[1] WHEN 'L' THEN fp[1] WHEN 'R' THEN vp[2] WHEN 'C' THEN vp[5] WHEN 'G' THEN vp[1] WHEN 'M' THEN vp[3] END AS fx FROM q LEFT JOIN parsed ON tf_id=stos_id),
long AS (SELECT stos_id, 'downsample' AS field_name, ds AS value FROM x UNION ALL SELECT stos_id, 'mapped_width', {_pixels('dims[-2]', 'd_scale', 'd_full')} FROM x WHERE len(dims)>=2 UNION ALL SELECT stos_id, 'mapped_height', {_pixels('dims[-1]', 'd_scale', 'd_full')} FROM x WHERE len(dims)>=2 UNION ALL SELECT stos_id, 'transform_x', {_pixels('fx', 'x_scale', 'x_full')} FROM x)
SELECT stos_id, field_name, round(value)::BIGINT AS value_px FROM long WHERE value IS NOT NULL"""


def with_transforms_sql(parse: str) -> dict[str, str]:
    """Queries that need the parsed transforms."""
    return {"p5_found": _with_units(parse)}
