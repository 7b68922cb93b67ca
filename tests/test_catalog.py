"""The catalogue's three sources: what each may set, and which wins."""

from gridpulse.operators import catalog as c

M = "message_id long, t long, texto string"
X = "message_id long, t long, via string, validador_version int, por_confirmar array<string>, circuitos array<struct<codigos array<string>, codigos_estado array<string>, calles string, municipio string, estado string>>"
ALIASES = [("playa", "Playa"), ("cerro", "Cerro")]


def test_three_sources(spark):
    posts = [
        (1, 10, "Actualización de afectaciones: ✅AB12 (Playa) - 5 horas ✅CD34 - 7 horas"),
        (2, 20, "Se restablece el servicio, bloque 3, Cerro\n👉AB12 - Calle 5 entre 1 y 3\n👉 CD34 - x"),
        (3, 30, "Afectado por avería\n👉AB12 - corta"),
        (4, 40, None),
    ]
    item = lambda codes, written, streets=None, town=None, state="con servicio": (codes, written, streets, town, state)
    models = [
        (5, 50, "llm", 3, ["ZZ99"], [item(["AB12", "ZZ99", "EF56"], ["EF56"], "una lista de calles mucho más larga", "Boyeros")]),
        (6, 60, "llm", 1, None, [item(["AB12"], ["AB12"], "x" * 90)]),
        (7, 70, "reglas", 3, None, [item(["AB12"], ["AB12"], "x" * 90)]),
        (8, 80, "llm", 3, None, [item(["AB12"], None, "x" * 90)]),
        (9, 90, "llm", 2, None, [item(["CD34"], ["CD34"], None, "Regla", "sin servicio")]),
    ]
    m = spark.createDataFrame(posts, M)
    out = c.folded(c.post_mentions(m, ALIASES).unionByName(c.deficit_mentions(m, ALIASES)).unionByName(c.model_mentions(spark.createDataFrame(models, X))))
    got = {r.codigo: r.asDict() for r in out.collect()}
    assert set(got) == {"AB12", "CD34", "EF56"}
    ab = got["AB12"]
    assert (ab["veces"], ab["primera"], ab["ultima"], ab["ultima_message_id"], ab["bloque"], ab["municipio"]) == (3, 10, 50, 5, 3, "Cerro")
    assert ab["calles"] == "una lista de calles mucho más larga" and ab["causa"] == "avería"
    cd = got["CD34"]  # streets of one letter are no post mention; the bulletin named it first
    assert (cd["veces"], cd["municipio"], cd["causa"], cd["estado"], cd["calles"]) == (1, "Regla", "déficit de generación", "sin servicio", "")
    ef = got["EF56"]
    assert (ef["veces"], ef["municipio"], ef["causa"], ef["estado"]) == (0, "Boyeros", None, "con servicio")


def test_no_mentions(spark):
    m, x = spark.createDataFrame([], M), spark.createDataFrame([], X)
    assert c.folded(c.post_mentions(m, ALIASES).unionByName(c.deficit_mentions(m, ALIASES)).unionByName(c.model_mentions(x))).count() == 0
