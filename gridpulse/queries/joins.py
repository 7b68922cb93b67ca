"""Joins (inventory J1 to J22), over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpulse.functions import text as t
from gridpulse.operators.history import latest_per_key
from gridpulse.operators.matching import contained_names, longest_name, token_matches
from gridpulse.operators.state import seconds
from gridpulse.queries.history import block_state, verdicts
from gridpulse.queries.rollups import catalog_fold, official
from gridpulse.plans.lineage import small
from gridpulse.sources.tables import table

MOST_BARRIOS = 50_000


def catalog_left_join(spark, d):
    """Circuits of deficit announcements with what the catalogue knows of them."""
    cut = official(spark, d).where("causa = 'déficit de generación' AND tipo = 'afectacion'").select("id", F.explode("zonas").alias("codigo"))
    return cut.join(catalog_fold(spark, d).select("codigo", "bloque", "municipio"), "codigo", "left")


def catalog_full_merge(spark, d):
    """Learned circuits and the official table of zones by (block, municipality); the official side wins."""
    learned = catalog_fold(spark, d).where("bloque IS NOT NULL AND municipio IS NOT NULL").groupBy("bloque", "municipio").agg(F.count("*").alias("circuitos"))
    zones = table(spark, d, "zonas_cuadrantes").where("bloque IS NOT NULL").groupBy("bloque", "municipio").agg(F.count("*").alias("zonas"), F.sum(F.col("area_km2").cast("decimal(12,3)")).cast("double").alias("area"))
    return learned.join(zones, ["bloque", "municipio"], "full_outer").withColumn("fuente", F.when(F.col("zonas").isNotNull(), "oficial").otherwise("aprendida"))


def town_authority(spark, d):
    """A report's municipality: the status document's if it has one, else its neighbourhood's, else none."""
    e = table(spark, d, "estado").select("item_id", "municipio", "direccion").distinct()
    b = table(spark, d, "barrios").select("barrio_id", "nombre", F.col("municipio").alias("b_municipio"))
    hit = longest_name(contained_names(e.where("direccion IS NOT NULL"), "item_id", F.col("direccion"), b, "barrio_id", F.col("nombre")), "item_id", "barrio_id")
    x = e.join(hit, "item_id", "left").join(small(b.select("barrio_id", "b_municipio"), MOST_BARRIOS), "barrio_id", "left")
    return x.select("item_id", F.coalesce("municipio", "b_municipio").alias("municipio"), F.when(F.col("municipio").isNotNull(), "documento").when(F.col("b_municipio").isNotNull(), "barrio").alias("fuente"))


def anti_pending(spark, d):
    """Comments without a structured row."""
    m = table(spark, d, "mensajes").where("chat = 'comentarios'").select("message_id").distinct()
    return m.join(table(spark, d, "comentarios_llm").select("message_id"), "message_id", "left_anti")


def changed_fragments(spark, d):
    """Documents whose stored hash is missing or differs: only these need a new embedding."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha1("text").alias("hash"), "n_chars", F.length("text").alias("n"))
    stored = docs.where("n_chars = n").select("doc_id", "hash")
    return docs.select("doc_id", "hash").join(stored, ["doc_id", "hash"], "left_anti")


def semi_pinned(spark, d):
    """Messages that an event refers to."""
    m = table(spark, d, "mensajes").select("chat", "message_id").distinct()
    return m.join(table(spark, d, "eventos").select("chat", "message_id"), ["chat", "message_id"], "left_semi")


def rota_flag(spark, d):
    """Catalogue with a mark on circuits of the newest DAF announcements of their block."""
    daf = official(spark, d).where("causa = 'DAF'").select(F.explode("zonas").alias("codigo")).distinct().withColumn("daf", F.lit(True))
    return catalog_fold(spark, d).select("codigo").join(daf, "codigo", "left").select("codigo", F.coalesce("daf", F.lit(False)).alias("daf"))


def set_diff_pairs(spark, d):
    """Codes of the event only, and of the message text only, of each official message that has both."""
    e = official(spark, d).groupBy("message_id").agg(F.array_distinct(F.flatten(F.collect_list("zonas"))).alias("a"))
    m = table(spark, d, "mensajes").where("chat = 'canal'").select("message_id", t.code_words(F.col("texto")).alias("b")).distinct()
    x = e.join(m, "message_id").select("message_id", F.array_join(F.array_sort(F.array_except("a", "b")), "|").alias("solo_evento"), F.array_join(F.array_sort(F.array_except("b", "a")), "|").alias("solo_texto"))
    return x.where("solo_evento <> '' OR solo_texto <> ''")


def names_in_text(spark, d):
    """Neighbourhoods named in official posts."""
    m = table(spark, d, "mensajes").where("chat = 'canal' AND texto IS NOT NULL").select("message_id", "texto")
    return contained_names(m, "message_id", F.col("texto"), table(spark, d, "barrios"), "barrio_id", F.col("nombre"))


def longest_mention(spark, d):
    m = table(spark, d, "mensajes").where("chat = 'comentarios' AND texto IS NOT NULL").select("message_id", "texto")
    return longest_name(contained_names(m, "message_id", F.col("texto"), table(spark, d, "barrios"), "barrio_id", F.col("nombre")), "message_id", "barrio_id")


def barrio_class(spark, d):
    """Neighbourhoods by what names them: block posts, DAF posts, or none (candidate)."""
    b = table(spark, d, "barrios").select("barrio_id")
    named = names_in_text(spark, d).join(official(spark, d).select("message_id", "causa", "bloque"), "message_id")
    seen = named.groupBy("barrio_id").agg(F.max(F.col("bloque").isNotNull()).alias("b"), F.max(F.col("causa") == "DAF").alias("f"))
    return b.join(seen, "barrio_id", "left").select("barrio_id", F.when(F.col("b"), "bloque").when(F.col("f"), "daf").otherwise("candidato").alias("clase"))


def token_match(spark, d):
    """Status items against the zones of the official table by street and zone tokens."""
    e = table(spark, d, "estado").where("direccion IS NOT NULL").select("item_id", "direccion").distinct()
    return token_matches(e, "item_id", F.col("direccion"), table(spark, d, "zonas_cuadrantes"), "zona_id", F.concat_ws(" ", "zona", "municipio"))


def resolve_cascade(spark, d):
    """An item's circuit or zone: a written code first, then a leading number that is a circuit's, then a token match, else none."""
    e = table(spark, d, "estado").where("direccion IS NOT NULL").select("item_id", "direccion").distinct()
    coded = e.select("item_id", F.get(t.code_words(F.upper("direccion")), F.lit(0)).alias("codigo")).where("codigo IS NOT NULL").groupBy("item_id").agg(F.min("codigo").alias("codigo"))
    known = table(spark, d, "eventos").select(F.explode("zonas").alias("numero")).where(r"numero RLIKE '^[0-9]+$'").distinct()
    bare = e.select("item_id", F.explode(t.leading_codes(F.col("direccion"))["codigos"]).alias("numero")).join(known, "numero", "left_semi").groupBy("item_id").agg(F.min("numero").alias("numero"))
    x = e.select("item_id").distinct().join(coded, "item_id", "left").join(bare, "item_id", "left").join(token_match(spark, d).select("item_id", "zona_id"), "item_id", "left")
    via = F.when(F.col("codigo").isNotNull(), "codigo").when(F.col("numero").isNotNull(), "catalogo").when(F.col("zona_id").isNotNull(), "tokens").otherwise("ninguno")
    return x.select("item_id", F.coalesce(F.col("codigo"), F.col("numero"), F.col("zona_id").cast("string")).alias("resuelto"), via.alias("via"))


def canonical_towns(spark, d):
    """Every canonical municipality contained in the raw name, else the raw name itself."""
    raw = table(spark, d, "estado").select("municipio").where("municipio IS NOT NULL").distinct()
    names = table(spark, d, "barrios").where("municipio IS NOT NULL").select(F.col("municipio").alias("canon")).distinct().withColumn("c", t.fold(F.col("canon"))).where("c <> ''").withColumn("k", F.left("c", F.lit(3)))
    # names join by the three letters they begin with, wherever these stand in the raw name
    keyed = raw.withColumn("f", t.fold(F.col("municipio"))).where("f <> ''").select("municipio", "f", F.explode(F.expr("array_distinct(flatten(transform(sequence(1, length(f)), i -> transform(sequence(1, 3), n -> substring(f, i, n)))))")).alias("k"))
    hit = keyed.join(names, "k").where(F.col("f").contains(F.col("c"))).select("municipio", "canon").distinct()
    return raw.join(hit, "municipio", "left").select("municipio", F.coalesce("canon", "municipio").alias("canon"))


def alias_fallback(spark, d):
    """The zone's neighbourhood by exact name, then by the name without its direction."""
    z = table(spark, d, "zonas_cuadrantes").select("zona_id", "zona")
    b = small(table(spark, d, "barrios").select("barrio_id", "nombre"), MOST_BARRIOS)
    exact = z.join(b, z.zona == b.nombre, "left").select("zona_id", "zona", F.col("barrio_id").alias("a"))
    short = exact.withColumn("corto", F.regexp_replace("zona", " (norte|sur|este|oeste)$", "")).join(b, F.col("corto") == F.col("nombre"), "left")
    return short.select("zona_id", F.coalesce("a", "barrio_id").alias("barrio_id"))


def obsolete_reports(spark, d):
    """Reports of service back that are older than the current outage of their block."""
    e = table(spark, d, "eventos").where("tipo = 'reporte_con_servicio' AND fecha IS NOT NULL").select("id", "bloque", seconds(F.col("fecha")).alias("t"))
    out = block_state(spark, d).where("estado = 'afectado'").select("bloque", "desde")
    return e.join(F.broadcast(out), "bloque").where("t < desde").select("id", "bloque", "t")


def cleared_emergency(spark, d):
    """Emergency circuits that a later restoration lists."""
    v = verdicts(spark, d).where("bloque = 0")
    off = latest_per_key(v.where("estado = 'sin servicio'"), ["codigo"], ["t", "id"]).select("codigo", "t")
    back = verdicts(spark, d).where("estado = 'con servicio'").select("codigo", F.col("t").alias("vuelta"))
    return off.join(back, "codigo").where("vuelta > t").groupBy("codigo").agg(F.min("vuelta").alias("vuelta"))


def zone_names(spark, d):
    """Zones and neighbourhoods that share a folded name; the name without its direction counts too."""
    z = table(spark, d, "zonas_cuadrantes").select("zona_id", F.explode(F.array_distinct(F.array(t.canon_street(F.col("zona")), t.canon_street(F.regexp_replace("zona", " (norte|sur|este|oeste)$", ""))))).alias("clave"))
    b = table(spark, d, "barrios").select("barrio_id", t.canon_street(F.col("nombre")).alias("clave"))
    return z.join(b, "clave").select("zona_id", "barrio_id").distinct()


QUERIES = {f.__name__: f for f in (catalog_left_join, catalog_full_merge, town_authority, anti_pending, changed_fragments, semi_pinned, rota_flag, set_diff_pairs, names_in_text, longest_mention, barrio_class, token_match, resolve_cascade, canonical_towns, alias_fallback, obsolete_reports, cleared_emergency, zone_names)}

from gridpulse.queries import history as _h  # noqa: E402
from gridpulse.queries import rollups as _r  # noqa: E402
from gridpulse.queries.text import _fold  # noqa: E402

_CAT = f"cat AS ({_r.SQL['catalog_fold'].replace('WITH ' + _r._O + ',', 'WITH', 1)})"
_CLEAN = lambda x: f"trim(regexp_replace({_fold(x)}, '[^a-z0-9]+', ' ', 'g'))"
_SHORT = "regexp_replace(zona, ' (norte|sur|este|oeste)$', '')"


def _named(chat):
    return f"(SELECT DISTINCT message_id, barrio_id, clave FROM (SELECT DISTINCT message_id, {_CLEAN('texto')} AS x FROM mensajes WHERE chat = '{chat}' AND texto IS NOT NULL) m JOIN (SELECT barrio_id, {_CLEAN('nombre')} AS clave FROM barrios) b ON contains(' ' || x || ' ', ' ' || clave || ' '))"


_STOPS = "(" + ", ".join(f"'{w}'" for w in t.STREET_STOPS) + ")"


def _tokens(x):
    return f"list_distinct(list_filter(regexp_extract_all({_fold(x)}, '[a-z0-9]+'), lambda w: w NOT IN {_STOPS} AND (length(w) > 2 OR regexp_matches(w, '^[0-9]+$'))))"


_TOKEN = f"""q AS (SELECT item_id, {_tokens('direccion')} AS a FROM (SELECT DISTINCT item_id, direccion FROM estado WHERE direccion IS NOT NULL)), z AS (SELECT zona_id, {_tokens("concat_ws(' ', zona, municipio)")} AS b FROM zonas_cuadrantes),
 qt AS (SELECT item_id, len(a) AS na, unnest(a) AS w FROM q WHERE len(a) >= 2), zt AS (SELECT zona_id, len(b) AS nb, unnest(b) AS w FROM z WHERE len(b) >= 1),
 sc AS (SELECT item_id, zona_id, count(*) / least(na, nb) AS s1, count(*) / (na + nb - count(*)) AS s2 FROM qt JOIN zt USING (w) GROUP BY item_id, zona_id, na, nb),
 rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s1 DESC, s2 DESC, zona_id DESC) AS n FROM sc),
 tp AS (SELECT item_id, max(CASE WHEN n = 1 THEN zona_id END) AS zona_id, max(CASE WHEN n = 1 THEN s1 END) AS a1, coalesce(max(CASE WHEN n = 2 THEN s1 END), 0) AS b1, max(CASE WHEN n = 1 THEN s2 END) AS a2, coalesce(max(CASE WHEN n = 2 THEN s2 END), 0) AS b2 FROM rk WHERE n <= 2 GROUP BY item_id),
 tm AS (SELECT item_id, zona_id, round(a1, 2) AS s1 FROM tp WHERE a1 >= 0.6 AND (a1 / greatest(b1, 1e-9) >= 1.5 OR (a1 = b1 AND a2 / greatest(b2, 1e-9) >= 1.5)))"""

SQL = {
    "catalog_left_join": f"WITH {_r._O}, {_CAT}, x AS (SELECT id, unnest(zonas) AS codigo FROM o WHERE causa = 'déficit de generación' AND tipo = 'afectacion') SELECT x.codigo, x.id, cat.bloque, cat.municipio FROM x LEFT JOIN cat ON x.codigo = cat.codigo",
    "catalog_full_merge": f"WITH {_r._O}, {_CAT}, l AS (SELECT bloque, municipio, count(*) AS circuitos FROM cat WHERE bloque IS NOT NULL AND municipio IS NOT NULL GROUP BY ALL), z AS (SELECT bloque, municipio, count(*) AS zonas, CAST(sum(CAST(area_km2 AS DECIMAL(12,3))) AS DOUBLE) AS area FROM zonas_cuadrantes WHERE bloque IS NOT NULL GROUP BY ALL) SELECT bloque, municipio, circuitos, zonas, area, CASE WHEN zonas IS NOT NULL THEN 'oficial' ELSE 'aprendida' END AS fuente FROM l FULL JOIN z USING (bloque, municipio)",
    "anti_pending": "SELECT DISTINCT message_id FROM mensajes WHERE chat = 'comentarios' AND message_id NOT IN (SELECT message_id FROM comentarios_llm)",
    "changed_fragments": "SELECT doc_id, sha1(text) AS hash FROM documents WHERE text IS NOT NULL AND n_chars IS DISTINCT FROM length(text)",
    "semi_pinned": "SELECT DISTINCT chat, message_id FROM mensajes SEMI JOIN eventos USING (chat, message_id)",
    "rota_flag": f"WITH {_r._O}, {_CAT} SELECT codigo, codigo IN (SELECT unnest(zonas) FROM o WHERE causa = 'DAF') AS daf FROM cat",
    "set_diff_pairs": f"""WITH {_r._O}, e AS (SELECT message_id, list_distinct(flatten(list(zonas))) AS a FROM o GROUP BY message_id), m AS (SELECT DISTINCT message_id, list_distinct(list_filter(string_split_regex(coalesce(texto, ''), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z]{{1,3}}[0-9]{{1,4}}$'))) AS b FROM mensajes WHERE chat = 'canal')
 SELECT * FROM (SELECT message_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|') AS solo_evento, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), '|') AS solo_texto FROM e JOIN m USING (message_id)) WHERE solo_evento <> '' OR solo_texto <> ''""",
    "names_in_text": f"SELECT * FROM {_named('canal')}",
    "longest_mention": f"SELECT message_id, barrio_id FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY length(clave) DESC, barrio_id) AS n FROM {_named('comentarios')}) WHERE n = 1",
    "barrio_class": f"WITH {_r._O}, s AS (SELECT barrio_id, max(bloque IS NOT NULL) AS b, max(causa = 'DAF') AS f FROM {_named('canal')} JOIN o USING (message_id) GROUP BY barrio_id) SELECT x.barrio_id, CASE WHEN b THEN 'bloque' WHEN f THEN 'daf' ELSE 'candidato' END AS clase FROM barrios x LEFT JOIN s ON x.barrio_id = s.barrio_id",
    "token_match": f"WITH {_TOKEN} SELECT * FROM tm",
    "canonical_towns": f"WITH raw AS (SELECT DISTINCT municipio FROM estado WHERE municipio IS NOT NULL), n AS (SELECT DISTINCT municipio AS canon FROM barrios WHERE municipio IS NOT NULL) SELECT municipio, coalesce(canon, municipio) AS canon FROM raw LEFT JOIN n ON contains({_fold('municipio')}, {_fold('canon')})",
    "alias_fallback": f"SELECT z.zona_id, coalesce(a.barrio_id, b.barrio_id) AS barrio_id FROM zonas_cuadrantes z LEFT JOIN barrios a ON z.zona = a.nombre LEFT JOIN barrios b ON {_SHORT.replace('zona,', 'z.zona,')} = b.nombre",
    "obsolete_reports": f"WITH {_h._BLOCK_STATE} SELECT e.id, e.bloque, CAST(floor(epoch(e.fecha)) AS BIGINT) AS t FROM eventos e JOIN block_state s ON e.bloque = s.bloque AND s.estado = 'afectado' WHERE e.tipo = 'reporte_con_servicio' AND e.fecha IS NOT NULL AND CAST(floor(epoch(e.fecha)) AS BIGINT) < s.desde",
    "cleared_emergency": f"WITH {_h._VERDICTS}, x AS (SELECT codigo, max(t) AS t FROM v WHERE bloque = 0 AND estado = 'sin servicio' GROUP BY codigo) SELECT x.codigo, min(v.t) AS vuelta FROM x JOIN v ON x.codigo = v.codigo AND v.estado = 'con servicio' AND v.t > x.t GROUP BY x.codigo",
}
