"""Typed values out of bulletin and comment texts, as Column expressions: everything stays in the JVM.

Null in gives null out (empty arrays where a list is asked for); nothing here raises on odd or empty text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns of the bulletin language.
ACCENTED, PLAIN = "áàäâãéèëêíìïîóòöôõúùüûñç", "aaaaaeeeeiiiiooooouuuunc"
TOWN_ALIASES = [
    ("10 de octubre", "10 de Octubre"),
    ("diez de octubre", "10 de Octubre"),
    ("arroyo naranjo", "Arroyo Naranjo"),
    ("boyeros", "Boyeros"),
    ("centro habana", "Centro Habana"),
    ("cerro", "Cerro"),
    ("cotorro", "Cotorro"),
    ("guanabacoa", "Guanabacoa"),
    ("habana del este", "Habana del Este"),
    ("habana vieja", "Habana Vieja"),
    ("la lisa", "La Lisa"),
    ("lisa", "La Lisa"),
    ("marianao", "Marianao"),
    ("playa", "Playa"),
    ("plaza de la revolucion", "Plaza"),
    ("plaza", "Plaza"),
    ("regla", "Regla"),
    ("san miguel del padron", "San Miguel del Padrón"),
]
TOTAL_LOSS = r"desconexi[oó]n total del (sistema electroenerg|sen\b)"
NOISE = r"^@|configura tu @username|bienvenid|para evitar ser silenciad"
CAUSES = [
    (r"disparo autom[aá]tico por frecuencia|\bDAF\b", "DAF"),
    (r"d[eé]ficit de generaci[oó]n|afectaciones? por d[eé]ficit", "déficit de generación"),
    (r"disparo por sobrecarga|\bsobrecarga\b", "sobrecarga"),
    (r"aver[ií]a", "avería"),
    (r"trabajos? de mantenimiento|mantenimiento programado", "mantenimiento"),
]
BLOCK = r"\bb(?:loque)?s?\s*(?:no\.?\s*)?#?\s*([1-6])\b"
BLOCK_LIST = r"\bbloques\s*((?:(?:no\.?\s*)?#?\s*[1-6]\s*[,y]?\s*)+)"
WITHOUT_SERVICE = r"sin (corriente|luz|electricidad|servicio)|no (hay|tenemos|tengo|llega la?) (corriente|luz|electricidad|servicio)|llevamos .{0,20}(horas?|d[ií]as?) sin|cu[aá]ndo .{0,30}(ponen|llega|restablecen)"
WITH_SERVICE = r"(lleg[oó]|pusieron|vino|regres[oó]|volvi[oó]) la (corriente|luz|electricidad)|ya (hay|tenemos|lleg[oó]|puso|vino) .{0,15}(corriente|luz|electricidad)|gracias por (la corriente|restablecer)"
RESTORES = r"restableci|quedan? reparad|con servicio los siguientes|teniendo con servicio|quedan? con servicio"
AFFECTS = r"se (ha )?afect|afectados? por|afectaciones|se localizan? aver|se detect[oa]|se interrump|averias? existentes|inicia la afectacion|afectando|circuitos? disparad"
PARTIAL = r"(continua|se trabaja|inicia)\b.{0,45}restablecimiento|de (forma|manera) (gradual|paulatina)|siguientes circuitos|servicio en los siguientes"
STATE_WITH = r"restableci|teniendo con servicio|quedan? con servicio|en servicio|reparad"
STATE_WITHOUT = r"se afect|afectaci|afectando|afectados|se localiza aver|via libre|disparo autom|\bdaf\b|emergencia"
FEED_TAGS = [
    (TOTAL_LOSS, "🔴 Desconexión SEN"),
    (r"actualizaci[oó]n de afectaciones", "📊 Parte de afectación"),
    (r"aver[ií]as existentes", "🚧 Averías"),
    (r"emergencia en la generaci", "⚠️ Emergencia"),
    (r"\brestableci", "✅ Restablecimiento"),
    (r"disparo autom[aá]tico|\bdaf\b", "🟡 DAF"),
    (r"actualizaci[oó]n del sistema electroenerg", "⚡ Parte del SEN"),
    (r"se afecta|afectaci[oó]n|afectados", "🔻 Afectación"),
]
OTHER_TAG = "📢 Aviso"
FAULT_KINDS = [
    (r"transformador", "Transformador dañado"),
    (r"subestaci", "Subestación"),
    (r"primario|conductor.*part|part.*conductor", "Primario/conductor partido"),
    (r"puente", "Puente partido"),
    (r"poste", "Poste partido"),
    (r"cable", "Cable con fallo"),
    (r"soterrad", "Soterrado"),
    (r"circuito.*dispar|dispar.*circuito", "Circuito disparado"),
    (r"combusti|linea|línea", "Línea/combustión"),
    (r"secundari", "Avería secundaria"),
    (r"primaria", "Avería primaria"),
]
CODE = r"(?:[A-Za-z]{1,3}\d{1,4}|\d{2,4})"
CODE_GAP = r"(?:\s*[,/]\s*|\s+[yeYE]\s+)"
MENTION = rf"👉[\x{{1F3FB}}-\x{{1F3FF}}]?\s*({CODE}(?:{CODE_GAP}{CODE})*)\s*([-–:])?\s*([^\n👉]+?)\s*(?=👉|\n|$)"
BLOCK_HOURS = r"Bloque\s*(\d)\s*(\d{1,3})\s*horas?(?:\s*y\s*(\d{1,2})\s*minutos?)?"
CIRCUIT_HOURS = r"([A-Za-z]{1,3}\d{1,4}|\d{3,4})\s*(?:\([^)]{2,30}\))?\s*-?\s*(\d+)\s*horas?(?:\s*y\s*(\d{1,2})\s*minutos?)?"
CLAIMED = r"llev(?:amos|o|an?|a)\s+(?:ya\s+|m[aá]s de\s+|casi\s+)?(\d{1,2})\s*(horas?|h\b|d[ií]as?)"
RELEVANT = r"circuito|bloque|afectaci|restablec|aver[ií]a|d[eé]ficit|desconexi|MW|disparo"
GENERATION = r"\bCTE\b|central(?:es)?\s+termoel[eé]ctrica|arranque\s+de\s+unidades?|(?:iniciando|preparad[ao]s?\s+para)\s+(?:el\s+)?arranque|(?:unidad|bloque)\s+\d+\s+(?:de\s+la\s+)?CTE|sincronizaci[oó]n\s+de\s+la\s+unidad"
BULLETS = "👉💥📌📈"
TAIL_SIGNS = "[🚧📉✅🔔‼️⚡️📣📌]+$"
STREET_STOPS = ["calle", "calles", "desde", "hasta", "entre", "y", "e", "la", "el", "los", "las", "de", "del", "reparto", "repartos", "zona", "zonas", "avenida", "ave", "final", "parte", "esquina"]


def has(text: Column, pattern: str) -> Column:
    """Case-insensitive match that also folds accented capitals."""
    return F.coalesce(text.rlike("(?iu)" + pattern), F.lit(False))


def fold(text: Column) -> Column:
    """Lower case without accents, stored composed or apart."""
    return F.translate(F.regexp_replace(F.lower(text), "[\\x{0300}-\\x{036F}]", ""), ACCENTED, PLAIN)


def fold_toponym(text: Column, drop: str = r"reparto|barrio|zona|municipio", parentheses: str = "drop") -> Column:
    """Folded name without generic words; text in parentheses is dropped or kept."""
    base = F.regexp_replace(fold(text), r"\([^)]*\)", " ") if parentheses == "drop" else fold(text)
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(base, rf"\b({drop})\b", " "), "[^a-z0-9 ]", " "), " +", " "))


def fold_street(text: Column) -> Column:
    """Folded street name without the kind of way and without punctuation."""
    plain = F.regexp_replace(fold(text), r"\b(calle|avenida|ave|av|calzada|callejon|paseo|carretera|autopista)\b", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9 ]", " "), " +", " "))


def canon_street(text: Column) -> Column:
    """Street key: no parentheses, ordinals written out (7a and 7ma agree), letters and digits only."""
    plain = F.regexp_replace(fold(text), r"\([^)]*\)", "")
    for pattern, ordinal in ((r"\b(1|3)(?:ra|era|er|a)\b", "$1ra"), (r"\b2(?:da|a)\b", "2da"), (r"\b(4|5|6)(?:ta|a)\b", "$1ta"), (r"\b(7|10)(?:ma|a)\b", "$1ma"), (r"\b8(?:va|a)\b", "8va"), (r"\b9(?:na|a)\b", "9na")):
        plain = F.regexp_replace(plain, pattern, ordinal)
    return F.regexp_replace(F.regexp_replace(plain, r"^\s*(calle|avenida|ave|av|calzada)\b\.?", ""), "[^a-z0-9]", "")


def squash(text: Column) -> Column:
    """Folded, with every run of spaces, hard ones too, as one."""
    return F.btrim(F.regexp_replace(fold(text), "[\\s\\x{00A0}]+", " "))


def towns_in(text: Column, aliases: list[tuple[str, str]] = TOWN_ALIASES) -> Column:
    """Canonical municipalities whose alias stands as whole words in the text, in order of the aliases."""
    plain = fold(text)
    named = [F.when(plain.rlike(rf"(?<![a-z0-9_]){alias}(?![a-z0-9_])"), F.lit(name)) for alias, name in aliases]
    return F.coalesce(F.array_distinct(F.array_compact(F.array(*named))), F.array().cast("array<string>"))


def is_total_loss(text: Column) -> Column:
    """The grid is lost, and the text is not a later report on its recovery."""
    plain = fold(text)
    later = plain.contains("restablec") & plain.rlike(r"\btras (?:la )?desconexion total\b")
    return has(text, TOTAL_LOSS) & ~F.coalesce(later, F.lit(False))


def cause_of(text: Column) -> Column:
    ladder = F.when(is_total_loss(text), F.lit("desconexión total del SEN"))
    for pattern, name in CAUSES:
        ladder = ladder.when(has(text, pattern), F.lit(name))
    return ladder


def blocks_in(text: Column) -> Column:
    """Distinct blocks 1 to 6 named alone or in a list, ascending."""
    safe = F.coalesce(text, F.lit(""))
    single = F.regexp_extract_all(safe, F.lit("(?iu)" + BLOCK), F.lit(1))
    listed = F.flatten(F.transform(F.regexp_extract_all(safe, F.lit("(?iu)" + BLOCK_LIST), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit("([1-6])"), F.lit(1))))
    return F.transform(F.array_sort(F.array_union(single, listed)), lambda x: x.cast("int"))


def zones_in(text: Column) -> Column:
    """What the bulleted lines of an official post list, in order; labels other than zones and codes are cut off."""

    def one(line: Column) -> Column:
        body = F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(line, f"^[{BULLETS}\\x{{1F3FB}}-\\x{{1F3FF}}]+", "")), TAIL_SIGNS, ""))
        label = fold(F.btrim(F.substring_index(body, ":", 1)))
        rest = F.btrim(F.regexp_replace(body, "^[^:]*:", ""))
        kept = label.startswith("zona") | label.rlike(r"^(?:[a-z]{1,3}\d{1,4}|\d{2,4})\b")
        return F.when(~body.contains(":"), body).when(label == "municipio", F.lit("")).when(kept, body).otherwise(rest)

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.btrim)
    return F.filter(F.transform(F.filter(lines, lambda x: x.rlike(f"^[{BULLETS}]")), one), lambda x: x != "")


def post_kind(text: Column) -> Column:
    """afectacion, restablecimiento or restablecimiento_parcial; null if the post announces neither."""
    plain = fold(text)
    back, off = F.coalesce(plain.rlike(RESTORES), F.lit(False)), F.coalesce(plain.rlike(AFFECTS), F.lit(False))
    opens = F.lower(text).rlike(r"^[^\p{L}\p{N}_]*(✅|restableci|queda reparada)")
    restored = back & (~off | opens)
    return F.when(is_total_loss(text), F.lit("afectacion")).when(restored & plain.rlike(PARTIAL), F.lit("restablecimiento_parcial")).when(restored, F.lit("restablecimiento")).when(back | off, F.lit("afectacion"))


def post_blocks(text: Column) -> Column:
    """The blocks a post's events are for: all six at a total loss, 0 for emergency circuits, [null] if none is named."""
    named = F.concat(blocks_in(text), F.when(fold(text).rlike("circuitos? de emergencia"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    return F.when(is_total_loss(text), F.sequence(F.lit(1), F.lit(6))).when(F.size(named) == 0, F.array(F.lit(None).cast("int"))).otherwise(named)


def comment_kind(text: Column) -> Column:
    """reporte_sin_servicio or reporte_con_servicio; null for long texts and if both or none are claimed."""
    off, on = has(text, WITHOUT_SERVICE), has(text, WITH_SERVICE)
    return F.when((F.length(text) > 600) | (off == on), None).when(off, F.lit("reporte_sin_servicio")).otherwise(F.lit("reporte_con_servicio"))


def only_block(text: Column) -> Column:
    found = blocks_in(text)
    return F.when(F.size(found) == 1, found[0])


def service_state(text: Column) -> Column:
    plain = fold(text)
    return F.when(plain.rlike(STATE_WITH), F.lit("con servicio")).when(plain.rlike(STATE_WITHOUT), F.lit("sin servicio"))


def _ladder(text: Column, rungs: list[tuple[str, str]], other: Column) -> Column:
    return reduce(lambda c, r: c.when(has(text, r[0]), F.lit(r[1])), rungs[1:], F.when(has(text, rungs[0][0]), F.lit(rungs[0][1]))).otherwise(other)


def feed_tag(text: Column) -> Column:
    return F.when(text.isNotNull(), _ladder(text, FEED_TAGS, F.lit(OTHER_TAG)))


def fault_kind(text: Column) -> Column:
    low = F.lower(text)
    return F.when(text.isNotNull(), _ladder(low, FAULT_KINDS, F.left(F.concat(F.upper(F.left(low, F.lit(1))), F.substring(low, 2, 1 << 20)), F.lit(28))))


def megawatts(text: Column) -> Column:
    """The first figure of two to four digits in MW."""
    found = F.regexp_extract(text, r"(\d{2,4})\s*MW", 1)
    return F.when(found != "", found.cast("int"))


def _hours(hours: Column, minutes: Column) -> Column:
    """Hours to one decimal, half to even."""
    return F.bround((hours.cast("double") + F.coalesce(F.nullif(minutes, F.lit("")).cast("double"), F.lit(0.0)) / 60), 1)


def _captures(text: Column, pattern: str, groups: int) -> Column:
    """Array of structs g1.. of every match."""
    lists = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(i + 1)).alias(f"g{i + 1}") for i in range(groups)]
    return F.arrays_zip(*lists)


def block_hours(text: Column) -> Column:
    """Array of (bloque, horas) declared in a bulletin, blocks 1 to 6 only."""
    made = F.transform(_captures(text, BLOCK_HOURS, 3), lambda m: F.struct(m["g1"].cast("int").alias("bloque"), _hours(m["g2"], m["g3"]).alias("horas")))
    return F.filter(made, lambda m: m["bloque"].between(1, 6))


def circuit_hours(text: Column) -> Column:
    """Array of (codigo, horas)."""
    return F.transform(_captures(text, CIRCUIT_HOURS, 3), lambda m: F.struct(F.upper(m["g1"]).alias("codigo"), _hours(m["g2"], m["g3"]).alias("horas")))


def codes_of(text: Column, bare: str = r"\d{3,4}") -> Column:
    """Valid circuit codes of a list like 'l317 / 1244' or 'T44 y T41', upper case, in order."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), CODE_GAP), lambda x: F.upper(F.regexp_replace(x, r"\s", "")))
    return F.filter(pieces, lambda x: x.rlike(rf"^(?:[A-Z]{{1,3}}\d{{1,4}}|{bare})$"))


def circuit_mentions(text: Column) -> Column:
    """Array of (codigos, calles): bulleted circuits of a post; bare numbers need an explicit separator."""
    found = F.transform(
        _captures(text, MENTION, 3),
        lambda m: F.struct(
            F.filter(codes_of(m["g1"], r"\d{2,4}"), lambda c: c.rlike("^[A-Z]") | (m["g2"] != "")).alias("codigos"),
            clean_streets(m["g3"]).alias("calles"),
        ),
    )
    return F.filter(found, lambda m: F.size(m["codigos"]) > 0)


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def leading_codes(text: Column) -> Column:
    """Struct (codigos, resto): codes at the start; bare numbers need three or four digits and a separator."""
    t = stripped(text)
    gap = r"(?:\s*/\s*|\s+[yeYE]\s+)"
    lettered = rf"^((?:[A-Za-z]{{1,3}}\d{{1,4}})(?:{gap}(?:[A-Za-z]{{1,3}}\d{{1,4}}|\d{{3,4}}))*)\b\s*[-–:]?\s*(.*)"
    bare = rf"^((?:\d{{3,4}})(?:{gap}(?:[A-Za-z]{{1,3}}\d{{1,4}}|\d{{3,4}}))*)\s*[-–:]\s*(.*)"
    pattern = F.when(t.rlike(lettered), F.lit(1)).when(t.rlike(bare), F.lit(2)).otherwise(F.lit(0))
    pick = lambda g: F.when(pattern == 1, F.regexp_extract(t, lettered, g)).when(pattern == 2, F.regexp_extract(t, bare, g))
    return F.struct(codes_of(pick(1)).alias("codigos"), F.coalesce(stripped(pick(2)), t).alias("resto"))


def code_written(code: Column, text: Column) -> Column:
    """Is this very code written in the text? Bare numbers only in the context of a circuit."""
    c = F.upper(code)
    letters, digits = F.regexp_extract(c, "^([A-Z]{1,3})", 1), F.regexp_extract(c, r"(\d{1,4})$", 1)
    lettered = F.regexp_like(text, F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), letters, F.lit(r"\s*"), digits, F.lit("(?![A-Za-z0-9])")))
    contexts = F.concat(
        F.lit(r"(?iu)\bcircuitos?\s*(?:n[oú]mero\s*)?(?:[:#-]\s*)?"), c, F.lit(r"\b|(?m:^)\s*[^\w\n]*"), c, F.lit(r"\s*[-–:]|[A-Za-z]{1,3}\s*\d{1,4}\s*/\s*"), c, F.lit(r"\b|\b"), c, F.lit(r"\s*/\s*[A-Za-z]{1,3}\s*\d{1,4}")
    )
    return F.coalesce(F.when(c.rlike(r"^[A-Z]{1,3}\d{1,4}$"), lettered).when(c.rlike(r"^\d{3,4}$"), F.regexp_like(text, contexts)), F.lit(False))


def clean_streets(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "[📉🚧✅📣📌🔔‼️⚡️👉💥📈🔹]+", ""), F.lit(" .-–"))


def hours_claimed(text: Column) -> Column:
    """Hours of 'llevamos N horas'; days count 24 each."""
    n, unit = F.regexp_extract(text, "(?iu)" + CLAIMED, 1), F.regexp_extract(text, "(?iu)" + CLAIMED, 2)
    return F.when(n != "", n.cast("int") * F.when(F.lower(unit).startswith("d"), 24).otherwise(1))


def percent_of(text: Column) -> Column:
    """The figure of 'para el X %', 0 to 100."""
    found = F.regexp_extract(text, r"(?iu)para el (\d{1,3}(?:[.,]\d+)?)\s*%", 1)
    return F.when(found != "", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.replace(found, F.lit(","), F.lit(".")).cast("double"))))


def street_names(zone: Column, most: int = 10) -> Column:
    """Street names of a zone's description: split at punctuation and connectors, kinds of way dropped, the first `most`."""
    parts = F.transform(F.split(F.coalesce(zone, F.lit("")), r"(?iu)[,;:()]|\by\b|\be/|\bentre\b|\bdesde\b|\bhasta\b|\besq\.?\b|\besquina\b"), lambda x: F.btrim(F.regexp_replace(F.btrim(x), r"(?iu)^(calle|calles|ave\.?|avenida|av\.?|calzada|callej[oó]n|paseo|c/)\s*", "")))
    fit = F.filter(parts, lambda x: F.length(x).between(1, 35) & ((F.length(x) > 1) | x.rlike("^[A-Z0-9]$")) & ~fold(x).isin("reparto", "zona", "parte", "final", "de", "la", "el"))
    return F.slice(_first_spelling(fit), 1, most)


def _first_spelling(values: Column) -> Column:
    """Distinct without regard to case and accents; the first spelling stays."""
    return F.filter(values, lambda x, i: F.array_position(F.transform(values, fold), fold(x)) == i + 1)


def toponym_pieces(text: Column, most: int = 10) -> Column:
    """Folded street names of a description, cut at desde, entre and hasta."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\([^)]*\)", ""), r"[;,]|\s+y\s+")
    cut = F.transform(parts, lambda x: fold_street(F.regexp_replace(x, r"(?iu)\b(desde|entre|hasta)\b.*$", "")))
    lead = F.transform(cut, lambda x: F.regexp_replace(x, r"^(de|del|la|el|los|las|en) ", ""))
    return F.slice(F.array_distinct(F.filter(lead, lambda x: F.length(x).between(1, 30))), 1, most)


def geocode_candidates(zone: Column) -> Column:
    """At most three strings worth looking up: what stands before a colon, then the first comma parts."""
    before = F.substring_index(zone, ":", 1)
    made = F.transform(F.concat(F.array(before), F.slice(F.split(before, ","), 1, 3)), lambda x: F.btrim(F.regexp_replace(x, r"(?iu)\b(zonas?|parte de|reparto)\b", "")))
    return F.slice(F.array_distinct(F.filter(made, lambda x: F.length(x) > 2)), 1, 3)


def locality_of(text: Column) -> Column:
    """X of 'En X: ...' unless it looks like a street or a zone."""
    found = F.btrim(F.regexp_extract(text, r"(?iu)^\s*en\s+([^:]{2,40}):", 1))
    return F.when((found != "") & ~has(found, r"\b(calle|ave|avenida|zona|entre)\b"), found)


def numbered_zones(text: Column) -> Column:
    """Numbers of one or two digits, without those of a 'micro'."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?iu)micro\s*\d+", " "), F.lit(r"(?<!\d)(\d{1,2})(?!\d)"), F.lit(1)), lambda x: x.cast("int"))


def promising_comment(text: Column) -> Column:
    """Worth an extraction: twelve characters or more and no greeting of the group's bot or mention at its start."""
    x = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.coalesce((F.length(x) >= 12) & ~has(x, NOISE), F.lit(False))


def relevant_post(text: Column) -> Column:
    return has(text, RELEVANT)


def ip_hash(address: Column, salt: str) -> Column:
    return F.sha2(F.concat(address, F.lit(salt)), 256)


def humanised(seconds: Column) -> Column:
    """'Nm', 'Hh Mm' or 'Dd Hh'."""
    m = F.floor(seconds / 60)
    h = F.floor(m / 60)
    return F.when(m < 60, F.format_string("%dm", m)).when(h < 24, F.format_string("%dh %dm", h, m % 60)).otherwise(F.format_string("%dd %dh", F.floor(h / 24), h % 24))


def code_key(code: Column) -> Column:
    return F.regexp_replace(fold(code), "[^a-z0-9]", "")


def code_prefix(code: Column) -> Column:
    return F.regexp_extract(F.upper(code), "^([A-Z]+)", 1)


def street_tokens(text: Column) -> Column:
    """Distinct tokens that can tell streets apart."""
    found = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STREET_STOPS) & ((F.length(w) > 2) | w.rlike("^[0-9]+$"))))


def code_words(text: Column) -> Column:
    """Words of the text that have the shape of a lettered circuit code."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Z]{1,3}[0-9]{1,4}$"))
