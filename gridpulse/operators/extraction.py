"""Events, fault items and validated extractions out of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpulse.functions import text as t

# The lines of fault bulletins.
FAULT_TYPE = r"^[🚨🛑]\s*(.+?)\s*:"
FAULT_TOWN = r"^📌\s*Municipios?\s*:\s*(.+)"
FAULT_ADDRESS = r"^(?:[👉💥]\s*Direcci[oó]n|📈\s*Afecta)\s*:\s*(.+)"
EXTRACTION = "tipo string, bloques array<int>, mw_deficit double, pct_restablecido double, circuitos array<struct<codigo:string, calles:string, municipio:string, estado:string, horas:double, causa:string>>"
KINDS = ["afectacion", "restablecimiento", "averia", "deficit", "caida_sen", "daf", "otro"]


def events_of(messages: DataFrame, aliases: list[tuple[str, str]] = t.TOWN_ALIASES) -> DataFrame:
    """Typed events of messages (chat, message_id, fecha, texto): one row for each block that a post is about.

    Official posts and comments go by their own rules; empty, null and unrecognised texts give no row.
    """
    x = F.col("texto")
    official = messages.where("chat = 'canal' AND texto <> ''").withColumn("tipo", t.post_kind(x)).where("tipo IS NOT NULL")
    official = official.select("chat", "message_id", "tipo", F.explode(t.post_blocks(x)).alias("bloque"), t.towns_in(x, aliases).alias("municipios"), t.zones_in(x).alias("zonas"), t.cause_of(x).alias("causa"), "fecha")
    public = messages.where("chat <> 'canal' AND texto <> ''").withColumn("tipo", t.comment_kind(x)).where("tipo IS NOT NULL")
    none = F.array().cast("array<string>")
    public = public.select("chat", "message_id", "tipo", t.only_block(x).alias("bloque"), t.towns_in(x, aliases).alias("municipios"), none.alias("zonas"), F.lit(None).cast("string").alias("causa"), "fecha")
    return official.unionByName(public)


def fault_items(messages: DataFrame) -> DataFrame:
    """(message_id, pos, tipo, clase, municipio, direccion) of fault bulletins.

    A type line sets the type and clears the municipality, a municipality line sets it, an address line gives a row; an
    address before any type line is ignored. One message's lines are ordered, never a whole table.
    """
    lines = messages.where(F.col("texto").rlike("[🚨🛑]")).select("message_id", F.posexplode(F.split("texto", "\n")).alias("pos", "line")).withColumn("line", F.btrim("line"))
    kind = F.nullif(F.regexp_extract("line", FAULT_TYPE, 1), F.lit(""))
    town = F.nullif(F.btrim(F.regexp_extract("line", FAULT_TOWN, 1), F.lit(" .")), F.lit(""))
    address = F.nullif(F.btrim(F.regexp_extract("line", FAULT_ADDRESS, 1), F.lit(" .")), F.lit(""))
    w = Window.partitionBy("message_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select("message_id", "pos", kind.alias("kind"), town.alias("town"), address.alias("direccion"))
    run = marked.withColumn("tipo", F.last("kind", ignorenulls=True).over(w)).withColumn("__g", F.count("kind").over(w))
    in_run = Window.partitionBy("message_id", "__g").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = run.withColumn("municipio", F.last("town", ignorenulls=True).over(in_run))
    return run.where("direccion IS NOT NULL AND tipo IS NOT NULL").select("message_id", "pos", "tipo", t.fault_kind(F.col("tipo")).alias("clase"), "municipio", "direccion")


def validated(rows: DataFrame, extraction: str, text: str) -> DataFrame:
    """rows with a raw extraction (JSON) coerced to the schema: unknown kinds become 'otro', blocks outside 1..6 go.

    A text on power plants that names no distribution circuit yields no circuits. A state needs evidence: the code itself
    must be written in the text. Malformed JSON gives kind 'otro' and no circuits.
    """
    x = F.from_json(F.regexp_extract(F.col(extraction), r"(?s)\{.*\}", 0), EXTRACTION)
    barred = t.has(F.col(text), t.GENERATION) & ~t.has(F.col(text), r"\bcircuitos?\b")
    made = F.transform(
        F.col("__x.circuitos"),
        lambda c: F.struct(
            t.codes_of(c["codigo"]).alias("codigos"),
            F.nullif(F.btrim(c["calles"]), F.lit("")).alias("calles"),
            F.nullif(F.btrim(c["municipio"]), F.lit("")).alias("municipio"),
            F.filter(t.codes_of(c["codigo"]), lambda k: t.code_written(k, F.col(text))).alias("codigos_estado"),
            c["estado"].alias("estado"),
            c["horas"].alias("horas"),
            F.nullif(F.btrim(c["causa"]), F.lit("")).alias("causa"),
        ),
    )
    stated = F.transform(made, lambda c: c.withField("estado", F.when((F.size(c["codigos_estado"]) > 0) & c["estado"].isin("con servicio", "sin servicio"), c["estado"])))
    none = F.expr("filter(transform(array(1), i -> named_struct('codigos', array(''), 'calles', '', 'municipio', '', 'codigos_estado', array(''), 'estado', '', 'horas', CAST(0 AS double), 'causa', '')), x -> false)")
    return rows.withColumn("__x", x).select(
        *rows.columns,
        F.when(F.col("__x.tipo").isin(*KINDS), F.col("__x.tipo")).otherwise(F.lit("otro")).alias("tipo"),
        F.coalesce(F.filter(F.col("__x.bloques"), lambda b: b.between(1, 6)), F.array().cast("array<int>")).alias("bloques"),
        F.col("__x.mw_deficit").alias("mw_deficit"),
        F.when(barred | F.col("__x.circuitos").isNull(), none).otherwise(stated).alias("circuitos"),
    )


def fragments(comments: DataFrame) -> DataFrame:
    """(message_id, texto): prose of structured comments of any kind; those with a blank or null place have none."""
    prose = F.concat_ws(". ", F.concat(F.lit("Comentario "), "reporta"), F.concat(F.lit("en "), F.btrim("lugar")), F.concat(F.lit("bloque "), "bloque"), F.concat(F.lit("desde hace "), "horas", F.lit(" h")))
    return comments.where(F.col("lugar").rlike(r"(?U)\S")).select("message_id", prose.alias("texto")).distinct()


def bulletin_fragments(extractions: DataFrame) -> DataFrame:
    """(message_id, texto): prose of official bulletins, one row each.

    extractions: message_id, fecha, tipo, municipios, calles, codigos (arrays of strings), mw_deficit. A bulletin without
    circuit, street, municipality and figure says nothing that could be found and has none.
    """
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.btrim(v)), lambda v: v.isNotNull() & (v != ""))
    towns, streets, codes = F.array_sort(F.array_distinct(clean(F.col("municipios")))), clean(F.col("calles")), clean(F.col("codigos"))
    said = lambda head, values, sep: F.when(F.size(values) > 0, F.concat(F.lit(head), F.array_join(values, sep), F.lit(".")))
    mw = F.when(F.col("mw_deficit") != 0, F.concat(F.lit("Déficit: "), F.col("mw_deficit").cast("string"), F.lit(" MW.")))
    head = F.concat(F.lit("Parte oficial del "), F.coalesce(F.date_format("fecha", "yyyy-MM-dd HH:mm"), F.lit("")), F.lit(": "), F.coalesce("tipo", F.lit("otro")), F.lit("."))
    body = F.concat_ws(" ", said("Municipios: ", towns, ", "), said("Zonas y calles afectadas: ", streets, "; "), said("Circuitos: ", codes, ", "), mw)
    return extractions.select("message_id", head.alias("head"), body.alias("body")).where("body <> ''").select("message_id", F.concat_ws(" ", "head", "body").alias("texto"))
