"""SQL of text rules, matching, geometry and state whose queries stand in the other modules."""

from __future__ import annotations

from gridpulse.functions import text as t
from gridpulse.queries import history as h
from gridpulse.queries import joins as j
from gridpulse.queries import rollups as r
from gridpulse.queries.analytics import _DIST, _EDGES, _P
from gridpulse.queries.text import _BLOCKS, _CANAL, _CAUSE, _COMMENT, _COMMENTS, _POST, _TOTAL, _TOWNS, _ZONES, _fold

QUERIES: dict = {}


def _street(x):
    return f"trim(regexp_replace(regexp_replace(regexp_replace({_fold(x)}, '\\b(calle|avenida|ave|av|calzada|callejon|paseo|carretera|autopista)\\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def _key(x):
    """Street key: parentheses out, ordinals in one form, the kind of way at the start out, letters and digits only."""
    plain = f"regexp_replace({_fold(x)}, '\\([^)]*\\)', '', 'g')"
    for pattern, ordinal in (("(1|3)(?:ra|era|er|a)", "\\1ra"), ("2(?:da|a)", "2da"), ("(4|5|6)(?:ta|a)", "\\1ta"), ("(7|10)(?:ma|a)", "\\1ma"), ("8(?:va|a)", "8va"), ("9(?:na|a)", "9na")):
        plain = f"regexp_replace({plain}, '\\b{pattern}\\b', '{ordinal}', 'g')"
    return f"regexp_replace(regexp_replace({plain}, '^\\s*(calle|avenida|ave|av|calzada)\\b\\.?', ''), '[^a-z0-9]', '', 'g')"


_CODE = "[A-Za-z]{1,3}\\d{1,4}"
_GAP = "(?:\\s*/\\s*|\\s+[yeYE]\\s+)"
_LETTERED = f"^((?:{_CODE})(?:{_GAP}(?:{_CODE}|\\d{{3,4}}))*)\\b\\s*[-–:]?\\s*(.*)"
_BARE = f"^((?:\\d{{3,4}})(?:{_GAP}(?:{_CODE}|\\d{{3,4}}))*)\\s*[-–:]\\s*(.*)"


def _leading(x):
    """(codes, rest) at the start of a line, as two expressions."""
    pick = f"CASE WHEN regexp_matches({x}, '{_LETTERED}') THEN regexp_extract({x}, '{_LETTERED}', 1) WHEN regexp_matches({x}, '{_BARE}') THEN regexp_extract({x}, '{_BARE}', 1) ELSE '' END"
    codes = f"list_filter(list_transform(string_split_regex({pick}, '(?:\\s*[,/]\\s*|\\s+[yeYE]\\s+)'), lambda c: upper(regexp_replace(c, '\\s', '', 'g'))), lambda c: regexp_matches(c, '^(?:[A-Z]{{1,3}}\\d{{1,4}}|\\d{{3,4}})$'))"
    rest = f"trim(CASE WHEN regexp_matches({x}, '{_LETTERED}') THEN regexp_extract({x}, '{_LETTERED}', 2) WHEN regexp_matches({x}, '{_BARE}') THEN regexp_extract({x}, '{_BARE}', 2) ELSE {x} END)"
    return codes, rest


_NAMED = f"list_concat(list_transform({_BLOCKS}, lambda b: CAST(b AS INT)), CASE WHEN coalesce(regexp_matches({_fold('texto')}, 'circuitos? de emergencia'), false) THEN [0] ELSE CAST([] AS INT[]) END)"
_EVENTS = f"""tw AS (SELECT DISTINCT chat, message_id, t.municipio FROM mensajes m JOIN {_TOWNS} t ON regexp_matches({_fold('m.texto')}, '(^|[^a-z0-9_])' || t.alias || '($|[^a-z0-9_])')),
 tj AS (SELECT chat, message_id, string_agg(municipio, '|' ORDER BY municipio) AS municipios, count(*) AS nt FROM tw GROUP BY ALL),
 zj AS (SELECT message_id, string_agg(zona, '|' ORDER BY i) AS zonas, count(*) AS nz FROM {_ZONES} WHERE zona <> '' GROUP BY message_id),
 ev AS (SELECT 'canal' AS chat, message_id, {_POST} AS tipo, unnest(CASE WHEN {_TOTAL} THEN [1, 2, 3, 4, 5, 6] WHEN len({_NAMED}) = 0 THEN [CAST(NULL AS INT)] ELSE {_NAMED} END) AS bloque, {_CAUSE} AS causa FROM {_CANAL} WHERE texto <> ''
  UNION ALL SELECT 'comentarios', message_id, {_COMMENT}, CASE WHEN len({_BLOCKS}) = 1 THEN CAST({_BLOCKS}[1] AS INT) END, NULL FROM {_COMMENTS} WHERE texto <> ''),
 events AS (SELECT ev.*, CASE WHEN ev.chat = 'canal' THEN coalesce(zonas, '') ELSE '' END AS zonas, coalesce(municipios, '') AS municipios, CASE WHEN ev.chat = 'canal' THEN coalesce(nz, 0) ELSE 0 END AS nz, coalesce(nt, 0) AS nt FROM ev LEFT JOIN zj ON ev.message_id = zj.message_id LEFT JOIN tj ON ev.message_id = tj.message_id AND ev.chat = tj.chat WHERE tipo IS NOT NULL)"""
_LINE = "regexp_replace(line, '^[^\\p{L}\\p{N}]+', '')"
_ITEM_CODES, _ = _leading("trim(direccion)")
_LINE_CODES, _LINE_REST = _leading(f"trim({_LINE})")
_HERE = "(SELECT DISTINCT item_id, direccion FROM estado WHERE direccion IS NOT NULL)"

SQL = {
    "street_forms": f"SELECT DISTINCT item_id, {_street('direccion')} AS street, {_key('direccion')} AS street_key FROM (SELECT DISTINCT item_id, direccion FROM estado WHERE direccion IS NOT NULL)",
    "event_rows": f"WITH {_EVENTS} SELECT chat, message_id, tipo, bloque, causa, zonas, municipios FROM events",
    "extract_events": f"WITH {_EVENTS} SELECT chat, tipo, bloque, causa, count(*) AS n, count(DISTINCT message_id) AS messages, CAST(sum(nz) AS BIGINT) AS zones, CAST(sum(nt) AS BIGINT) AS towns FROM events GROUP BY ALL",
    "stream_extract": f"WITH {_EVENTS} SELECT chat, tipo, bloque, causa, count(*) AS n FROM events GROUP BY ALL",
    "leading_codes": f"SELECT message_id, CAST(i - 1 AS INT) AS pos, array_to_string({_LINE_CODES}, '|') AS codigos, {_LINE_REST} AS resto FROM (SELECT message_id, unnest(string_split(coalesce(texto, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(texto, ''), chr(10)), 1) AS i FROM {_CANAL}) WHERE len({_LINE_CODES}) > 0",
    "code_evidence": f"""WITH e AS (SELECT DISTINCT message_id, unnest(zonas) AS codigo FROM eventos WHERE chat = 'canal'),
 s AS (SELECT codigo, coalesce(CASE WHEN regexp_matches(upper(codigo), '^[A-Z]{{1,3}}\\d{{1,4}}$') THEN regexp_matches(texto, '(?i)(^|[^A-Za-z0-9])' || regexp_extract(upper(codigo), '^([A-Z]{{1,3}})', 1) || '\\s*' || regexp_extract(codigo, '(\\d{{1,4}})$', 1) || '($|[^A-Za-z0-9])') END, false) AS written FROM e JOIN {_CANAL} USING (message_id))
 SELECT codigo, count(*) FILTER (written) AS n_written, count(*) AS n FROM s GROUP BY codigo""",
    "town_authority": f"""WITH e AS (SELECT DISTINCT item_id, municipio, direccion FROM estado), n AS (SELECT barrio_id, municipio AS b_municipio, {j._CLEAN('nombre')} AS clave FROM barrios),
 h AS (SELECT item_id, barrio_id FROM (SELECT item_id, barrio_id, row_number() OVER (PARTITION BY item_id ORDER BY length(clave) DESC, barrio_id) AS k FROM (SELECT DISTINCT item_id, {j._CLEAN('direccion')} AS x FROM e WHERE direccion IS NOT NULL) JOIN n ON contains(' ' || x || ' ', ' ' || clave || ' ')) WHERE k = 1)
 SELECT e.item_id, coalesce(e.municipio, b_municipio) AS municipio, CASE WHEN e.municipio IS NOT NULL THEN 'documento' WHEN b_municipio IS NOT NULL THEN 'barrio' END AS fuente FROM e LEFT JOIN h ON e.item_id = h.item_id LEFT JOIN n ON h.barrio_id = n.barrio_id""",
    "resolve_cascade": f"""WITH {j._TOKEN}, c AS (SELECT item_id, min(w) AS codigo FROM (SELECT item_id, list_filter(string_split_regex(upper(direccion), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z]{{1,3}}[0-9]{{1,4}}$'))[1] AS w FROM {_HERE}) WHERE w IS NOT NULL GROUP BY item_id),
 k AS (SELECT DISTINCT numero FROM (SELECT unnest(zonas) AS numero FROM eventos) WHERE regexp_matches(numero, '^[0-9]+$')), b AS (SELECT item_id, min(numero) AS numero FROM (SELECT item_id, unnest({_ITEM_CODES}) AS numero FROM {_HERE}) JOIN k USING (numero) GROUP BY item_id)
 SELECT i.item_id, coalesce(codigo, numero, CAST(zona_id AS VARCHAR)) AS resuelto, CASE WHEN codigo IS NOT NULL THEN 'codigo' WHEN numero IS NOT NULL THEN 'catalogo' WHEN zona_id IS NOT NULL THEN 'tokens' ELSE 'ninguno' END AS via
 FROM (SELECT DISTINCT item_id FROM {_HERE}) i LEFT JOIN c ON i.item_id = c.item_id LEFT JOIN b ON i.item_id = b.item_id LEFT JOIN tm ON i.item_id = tm.item_id""",
    "zone_names": f"SELECT DISTINCT zona_id, barrio_id FROM (SELECT zona_id, {_key('zona')} AS clave FROM zonas_cuadrantes UNION SELECT zona_id, {_key(j._SHORT)} FROM zonas_cuadrantes) JOIN (SELECT barrio_id, {_key('nombre')} AS clave FROM barrios) USING (clave)",
    "find_zone": f"""WITH cat AS ({r.SQL['catalog_fold']}), s AS ({h.SQL['circuit_status']}), f AS (SELECT cat.codigo, municipio, cat.bloque, s.estado AS vigente FROM cat LEFT JOIN s ON cat.codigo = s.codigo WHERE contains({_fold("concat_ws(' ', cat.codigo, municipio)")}, 'marvales'))
 SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY codigo LIMIT 25""",
    "border_distances": f"""WITH {_P}, z AS (SELECT zona_id, anillo, list_min(list_transform(anillo, lambda q: q.lon)) - 0.01 AS w, list_min(list_transform(anillo, lambda q: q.lat)) - 0.01 AS s, list_max(list_transform(anillo, lambda q: q.lon)) + 0.01 AS e, list_max(list_transform(anillo, lambda q: q.lat)) + 0.01 AS n FROM zonas_cuadrantes),
 v AS (SELECT zona_id, w, s, e, n, anillo[i].lat AS lat, anillo[i].lon AS lon FROM (SELECT *, unnest(range(1, len(anillo) + 1, 3)) AS i FROM z))
 SELECT * FROM (SELECT id, zona_id, round(min({_DIST.format(a='p', b='v')}), 3) AS metros FROM p JOIN v ON p.lon BETWEEN w AND e AND p.lat BETWEEN s AND n GROUP BY id, zona_id) WHERE metros < 800""",
    "interior_points": f"""WITH {_EDGES}, m AS (SELECT zona_id, list_sum(list_transform(anillo, lambda q: q.lat)) / len(anillo) AS lat FROM zonas_cuadrantes WHERE len(anillo) >= 3),
 c AS (SELECT zona_id, lat, list_sort(list((x2 - x1) * (lat - y1) / (y2 - y1) + x1)) AS xs FROM e JOIN m USING (zona_id) WHERE (y1 > lat) <> (y2 > lat) GROUP BY ALL),
 w AS (SELECT zona_id, lat, max((xs[k + 1] - xs[k], (xs[k + 1] + xs[k]) / 2)) AS best FROM (SELECT *, unnest(range(1, len(xs), 2)) AS k FROM c) GROUP BY ALL),
 i AS (SELECT w.zona_id, w.lat, best[2] AS lon FROM w)
 SELECT i.zona_id, round(i.lat, 5) AS lat, round(i.lon, 5) AS lon, count(*) FILTER ((y1 > i.lat) <> (y2 > i.lat) AND i.lon < (x2 - x1) * (i.lat - y1) / (y2 - y1) + x1) % 2 = 1 AS dentro FROM i JOIN e ON i.zona_id = e.zona_id GROUP BY i.zona_id, i.lat, i.lon""",
    "block_state_override": f"""WITH {h._BLOCK_STATE}, {h._DECLARED}, told AS (SELECT max(t) AS tt FROM dec WHERE t <= {h._NOW}), l AS (SELECT bloque, max(horas) AS hh FROM dec WHERE t = (SELECT tt FROM told) GROUP BY bloque),
 x AS (SELECT s.*, hh, tt, hh IS NOT NULL AND NOT coalesce(estado = 'restablecido' AND desde >= tt, false) AS listed, hh IS NULL AND s.bloque BETWEEN 1 AND 6 AND tt IS NOT NULL AS unlisted, coalesce(ult_afecta > tt, false) AS again FROM block_state s LEFT JOIN l ON s.bloque = l.bloque CROSS JOIN told)
 SELECT bloque, CASE WHEN listed OR (unlisted AND again) THEN 'afectado' WHEN unlisted THEN 'restablecido' ELSE estado END AS estado,
 CAST(CASE WHEN listed THEN tt - hh * 3600 WHEN unlisted AND again THEN ult_afecta WHEN unlisted THEN tt ELSE desde END AS BIGINT) AS desde, causa, ult_afecta, CASE WHEN listed OR estado = 'afectado' THEN parcial END AS parcial FROM x""",
}
