"""Joins over small tables."""

from gridpulse.queries import joins


def test_resolve_cascade_knows_bare_numbers_of_the_catalogue(spark, tmp_path, rows):
    estado = [(1, "circuito A12 - norte"), (2, "1243 - Toyo norte"), (3, "1299 - Toyo"), (4, "calle 1243"), (5, None)]
    spark.createDataFrame(estado, "item_id long, direccion string").write.parquet(str(tmp_path / "estado.parquet"))
    spark.createDataFrame([(["1243", "A12"],), (None,)], "zonas array<string>").write.parquet(str(tmp_path / "eventos.parquet"))
    spark.createDataFrame([(7, "otra cosa lejana", "Alba")], "zona_id long, zona string, municipio string").write.parquet(str(tmp_path / "zonas_cuadrantes.parquet"))
    assert rows(joins.resolve_cascade(spark, str(tmp_path))) == [(1, "A12", "codigo"), (2, "1243", "catalogo"), (3, None, "ninguno"), (4, None, "ninguno")]
