"""Files, loading and merging on hand-made input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillwatch.functions.text import fixed, flag, grouped, signed
from tillwatch.schemas import TRANSACTION_HEADINGS
from tillwatch.session import work_dir
from tillwatch.sources import fact_load, monthly_extracts, quarter_files, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


QUARTER = """01,20251027094500,9
02,100,2,5280000,20251027094500,4,20,104,50
02,100,3,10000,20251027094400,1,10,7
02,200,4,50000,20251027094300,1,50,2,50
02,200,5,99999,20251027094300,1,50
02,300,2
02,300,7,1,20251027094300,1,1
02,300,2,x,otra,1,20,z,50
02,400,10,1,20251027094300

02,500,2,3000,20251027094200
"""


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("quarter")
    write(folder / "a.txt", QUARTER)
    write(folder / "b.txt", "01,20251027100000,1\r\n02,100,2,20000,20251027095900,1,20\r\n")
    lines = quarter_files.read_lines(spark, str(folder))
    return lines, quarter_files.parse_lines(lines).orderBy("archivo_origen", "linea").collect()


def test_quarter_file_lines(parsed):
    rows = parsed[1]
    assert [(r.cod_cajero, r.cod_admin_efectivo) for r in rows] == [
        ("100", 2), ("100", 3), ("200", 4), ("300", 2), ("500", 2), ("100", 2)
    ]
    first, lone, twice, bad, bare, other = rows
    assert (first.billetes_20k, first.billetes_50k, first.billetes_100k) == (4, 104, None)
    assert first.monto_total == 4 * 20_000 + 104 * 50_000
    assert first.fecha_envio == dt.datetime(2025, 10, 27, 9, 45)
    assert lone.billetes_10k == 1  # the last field has no partner
    assert twice.billetes_50k == 2  # the last pair wins
    assert (bad.monto_total, bad.fecha_hora, bad.billetes_20k, bad.billetes_50k) == (None, None, 1, None)
    assert bare.billetes_20k is None and bare.tipo_admin == "Dispensacion acumulada"
    assert other.fecha_envio == dt.datetime(2025, 10, 27, 10, 0) and other.billetes_20k == 1


def test_quarter_file_summary(spark, parsed):
    lines, _ = parsed
    rows = quarter_files.file_summary(lines, quarter_files.parse_lines(lines)).orderBy("fecha_envio").collect()
    assert [(r.registros_esperados, r.registros, r.cajeros) for r in rows] == [(9, 5, 4), (1, 1, 1)]


def test_lines_of_a_split_file_keep_their_order(spark, tmp_path):
    body = "".join(f"02,{i},2,{i},20251027094500,1,20\n" for i in range(4000))
    write(tmp_path / "big" / "a.txt", "01,20251027094500,4000\n" + body)
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in old:
            spark.conf.set(c, "8192")
        lines = quarter_files.read_lines(spark, str(tmp_path / "big"))
        assert lines.rdd.getNumPartitions() > 4
        rows = quarter_files.parse_lines(lines).orderBy("linea").collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert [int(r.cod_cajero) for r in rows] == list(range(4000))
    assert {r.fecha_envio for r in rows} == {dt.datetime(2025, 10, 27, 9, 45)}


@pytest.mark.parametrize(
    "text, value",
    [(" sí ", True), ("SÍ", True), ("s", True), ("true", True), ("1", True), ("No", False), ("n", False),
     ("FALSE", False), ("0", False), ("tal vez", None), ("", None), (None, None)],
)
def test_flag(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(flag("t")).first()[0] is value


@pytest.mark.parametrize("x", [0.0, 0.05, 0.25, 2.5, 3.5, -0.04, 1234567.89, -1234.5, 1e-9, 99.95, 0.125])
def test_number_formats_match_python(spark, x):
    c = F.lit(x)
    row = spark.range(1).select(grouped(c), fixed(c, 1), fixed(c, 2), signed(c, 1)).first()
    assert list(row) == [f"{x:,.0f}", f"{x:.1f}", f"{x:.2f}", f"{x:+.1f}"]


HEADER = "," + ",".join(TRANSACTION_HEADINGS)


def line(i, day, value="100", tail=""):
    return (
        f"{i},{i},2024/01/{day:02d} 10:00:00,7,AUT,Retiro,1,3,op,ATM,conv,adq,{value},{value},1,0,2024-01-{day:02d}{tail}"
    )


@pytest.fixture
def extract(tmp_path):
    write(tmp_path / "enero" / "a.csv", "\n".join([HEADER, line(1, 1), line(2, 2, "x"), line(3, 32)]))
    write(tmp_path / "enero" / "b.csv", "\n".join([HEADER, line(4, 3), line(5, 3, tail=",sobra")]))
    write(tmp_path / "enero" / ".c.csv", "\n".join([HEADER, line(6, 4)]))
    write(tmp_path / "enero" / "notes.txt", "x")
    write(tmp_path / "febrero" / "a.csv", "\n".join([HEADER, line(1, 1), line(7, 5)]))
    (tmp_path / "marzo").mkdir()
    return str(tmp_path)


def test_months_with_bad_files(spark, extract):
    target = work_dir(spark, "months")
    errors = monthly_extracts.ingest_months(spark, extract, ["enero", "febrero", "marzo", "abril"], target)
    assert sorted((r.mes_origen, r.archivo_origen or "", r.error) for r in errors.collect()) == [
        ("abril", "", "Carpeta no encontrada"),
        ("enero", "b.csv", "1 lineas con campos de mas"),
        ("marzo", "", "Sin archivos CSV"),
    ]
    raw = monthly_extracts.read_consolidated(spark, target)
    rows = {(r["Id Tlf"], r.mes_origen): r for r in raw.collect()}
    assert set(rows) == {(1, "enero"), (2, "enero"), (3, "enero"), (1, "febrero"), (7, "febrero")}
    assert rows[2, "enero"]["Valor Transacción"] is None
    assert rows[3, "enero"]["Fecha Transacción"] is None
    assert rows[1, "enero"].archivo_origen == "a.csv"
    fact = fact_load.prepare_fact(raw, months=1).collect()
    assert sorted(r.id_tlf for r in fact) == [1, 2, 7]  # the copy of 1 and the row without time are gone
    assert [r.mes_origen for r in fact if r.id_tlf == 1] == ["enero"]


def test_fact_filters_reach_the_files(spark, extract):
    target = work_dir(spark, "fact")
    base = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), "Retiro", 5.0), (2, dt.datetime(2024, 1, 2), "Otro", 6.0)],
        "id_tlf long, fecha_transaccion timestamp_ntz, tipo_operacion string, valor_transaccion double",
    ).withColumns({"cod_terminal": F.lit(1), "dia": F.to_date("fecha_transaccion")})
    base.write.partitionBy("dia").parquet(target)
    rows = fact_load.keep_types(spark.read.parquet(target)).filter("dia = DATE '2024-01-01'").select("id_tlf")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "In(tipo_operacion, [Avance,Retiro])" in plan or "In(tipo_operacion, [Retiro,Avance])" in plan
    assert "PartitionFilters: [isnotnull(dia" in plan
    assert "valor_transaccion" not in plan.split("ReadSchema")[1]


def test_insert_twice_adds_nothing(spark):
    target = work_dir(spark, "fact")
    rows = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1 + i % 3), 1, float(i)) for i in range(9)] + [(1, dt.datetime(2024, 1, 2), 1, 99.0)],
        "id_tlf long, fecha_transaccion timestamp_ntz, cod_terminal int, valor_transaccion double",
    )
    assert fact_load.insert_if_absent(spark, rows, target) == {"insertados": 9, "omitidos": 0}
    assert fact_load.insert_if_absent(spark, rows, target) == {"insertados": 0, "omitidos": 9}
    assert spark.read.parquet(target).count() == 9


def test_merge_keeps_what_is_not_updated(spark):
    schema = "k int, a string, b string"
    old = spark.createDataFrame([(1, "a1", "b1"), (2, "a2", "b2")], schema)
    new = spark.createDataFrame([(2, None, "n2"), (3, "n3", "n3")], schema)
    got = sorted(tuple(r) for r in tables.merge_rows(old, new, ["k"], ["a"]).collect())
    assert got == [(1, "a1", "b1"), (2, None, "b2"), (3, "n3", "n3")]


def test_upsert_rewrites_only_the_days_it_meets(spark):
    target = work_dir(spark, "alerts")
    schema = "cod_cajero string, fecha_hora timestamp_ntz, severidad string, v double"
    first = spark.createDataFrame(
        [("1", dt.datetime(2024, 1, 1, 5), "medio", 1.0), ("1", dt.datetime(2024, 1, 2, 5), "medio", 2.0)], schema
    ).withColumn("dia", F.to_date("fecha_hora"))
    tables.upsert_partitions(spark, first, target, ["cod_cajero", "fecha_hora"], ["severidad"], "dia")
    before = {r.f for r in spark.read.parquet(target).select(F.input_file_name().alias("f")).collect()}
    second = spark.createDataFrame([("1", dt.datetime(2024, 1, 2, 5), "alto", 9.0)], schema).withColumn(
        "dia", F.to_date("fecha_hora")
    )
    for _ in range(2):  # a replay changes nothing
        tables.upsert_partitions(spark, second, target, ["cod_cajero", "fecha_hora"], ["severidad"], "dia")
    got = sorted((r.fecha_hora.day, r.severidad, r.v) for r in spark.read.parquet(target).collect())
    assert got == [(1, "medio", 1.0), (2, "alto", 2.0)]
    after = {r.f for r in spark.read.parquet(target).select(F.input_file_name().alias("f")).collect()}
    assert len(before & after) == 1



def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    from tillwatch import session

    class Context:
        master = "spark://elsewhere"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(Session(), "x")


def test_headings_decide_not_places(spark, tmp_path):
    heads = {v: k for k, v in TRANSACTION_HEADINGS.items()}
    known = [heads[c] for c in ("id_tlf", "fecha_transaccion", "cod_terminal", "autorizador", "tipo_operacion", "valor_transaccion")]
    ident, time, machine, auth, kind, amount = known
    write(tmp_path / "m" / "a.csv", f",{ident},{time},{machine},{auth},{kind},{amount}\n0,1,2024/01/05 10:00:00,7,A,Retiro,5.5\n")
    write(tmp_path / "m" / "b.csv", f",{kind},{auth},Nueva,{amount},{ident},{time}\n0,Avance,B,extra,NaN,2.0,2024/01/05 11:00:00\n1,Avance,B,extra,1,2.5,x\n")
    write(tmp_path / "m" / "c.csv", f"{ident},{machine}\n3,99999999999\n4,NaN\n12345678901234567890,3.0\n9007199254740993.0,1e3\n")
    write(tmp_path / "m" / "d.csv", f",{ident}\n0,5,surplus\n")
    rows, errors = monthly_extracts.load_month(spark, str(tmp_path), "m")
    assert [r.archivo_origen for r in errors.collect()] == ["d.csv"]
    fact = fact_load.rename_headings(rows)
    got = sorted(((r.archivo_origen, r.id_tlf, r.cod_terminal, r.autorizador, r.tipo_operacion, r.valor_transaccion) for r in fact.collect()), key=repr)
    assert got[0] == ("a.csv", 1, 7, "A", "Retiro", 5.5)
    assert got[1][:5] == ("b.csv", 2, None, "B", "Avance") and got[1][5] != got[1][5]
    assert got[2] == ("b.csv", None, None, "B", "Avance", 1.0)
    assert [g[1:3] for g in got[3:]] == [(3, None), (4, None), (9007199254740993, 1000), (None, 3)]


def test_a_month_loaded_twice_is_stored_once(spark, tmp_path):
    write(tmp_path / "in" / "m1" / "a.csv", ",Id Tlf\n0,1\n")
    write(tmp_path / "in" / "m2" / "a.csv", ",Id Tlf\n0,2\n")
    target = str(tmp_path / "out")
    for months in (["m1", "m2"], ["m1"], ["m1", "m1"]):
        monthly_extracts.ingest_months(spark, str(tmp_path / "in"), months, target)
    assert sorted(r["Id Tlf"] for r in monthly_extracts.read_consolidated(spark, target).collect()) == [1, 2]


def test_rows_without_key_are_not_copies(spark):
    rows = [(None, dt.datetime(2024, 1, 1), "x"), (None, dt.datetime(2024, 1, 1), "x"), (1, None, "y"), (1, None, "y"), (2, dt.datetime(2024, 1, 1), "b"), (2, dt.datetime(2024, 1, 1), "a")]
    df = spark.createDataFrame(rows, "id_tlf long, fecha_transaccion timestamp_ntz, v string")
    got = fact_load.drop_duplicates(df)
    assert sorted(r.v for r in got.collect()) == ["a", "x", "x", "y", "y"]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1


def test_a_stopped_merge_is_finished_by_the_next(spark, monkeypatch):
    target = work_dir(spark, "alerts")
    schema = "cod_cajero string, fecha_hora timestamp_ntz, severidad string, dia date"
    day = dt.date(2024, 1, 1)
    first = spark.createDataFrame([(str(i), dt.datetime(2024, 1, 1, i), "medio", day) for i in range(5)], schema)
    keys = ["cod_cajero", "fecha_hora"]
    tables.upsert_partitions(spark, first, target, keys, ["severidad"], "dia")
    second = spark.createDataFrame([("2", dt.datetime(2024, 1, 1, 2), "alto", day)], schema)
    whole = tables._replace_partitions

    def stop(merged, at, partition):
        tables.remove(spark, f"{at}/dia=2024-01-01")
        raise RuntimeError("stopped between delete and rename")

    monkeypatch.setattr(tables, "_replace_partitions", stop)
    with pytest.raises(RuntimeError):
        tables.upsert_partitions(spark, second, target, keys, ["severidad"], "dia")
    monkeypatch.setattr(tables, "_replace_partitions", whole)
    tables.upsert_partitions(spark, second, target, keys, ["severidad"], "dia")
    got = sorted((r.cod_cajero, r.severidad) for r in spark.read.parquet(target).collect())
    assert got == [(str(i), "alto" if i == 2 else "medio") for i in range(5)]


def test_one_bad_line_costs_one_line(spark, extract):
    target, kept = work_dir(spark, "months"), work_dir(spark, "quarantine")
    required = ["Fecha Transacción"]
    for _ in range(2):  # again: nothing is doubled
        errors = monthly_extracts.ingest_months(spark, extract, ["enero", "febrero", "abril"], target, kept, required)
    assert sorted((r.mes_origen, r.archivo_origen or "", r.error) for r in errors.collect()) == [
        ("abril", "", "Carpeta no encontrada"),
        ("enero", "a.csv", "1 lineas en cuarentena"),
        ("enero", "b.csv", "1 lineas en cuarentena"),
    ]
    rejected = spark.read.parquet(kept)
    assert sorted((r.archivo_origen, r.linea, r.motivo, r.texto.count(","), r.encabezado) for r in rejected.collect()) == [
        ("a.csv", 4, "valor ilegible: Fecha Transacción", HEADER.count(","), HEADER),
        ("b.csv", 3, "campos de mas", HEADER.count(",") + 1, HEADER),
    ]

    def stored():
        return sorted((r["Id Tlf"], r.mes_origen, r.archivo_origen) for r in monthly_extracts.read_consolidated(spark, target).collect())

    good = [(1, "enero", "a.csv"), (1, "febrero", "a.csv"), (2, "enero", "a.csv"), (4, "enero", "b.csv"), (7, "febrero", "a.csv")]
    assert stored() == good
    mended = rejected.withColumn("texto", F.replace("texto", F.lit(",sobra"), F.lit("")))
    still = monthly_extracts.replay_lines(spark, mended, target, required)
    assert [r.linea for r in still.collect()] == [4]
    assert stored() == sorted([*good, (5, "enero", "b.csv")])


def test_names_and_first_lines_of_files(spark, tmp_path):
    write(tmp_path / "m" / "a[1].csv", ",Id Tlf\n0,1\n")
    write(tmp_path / "m" / "b {x}*.csv", "\n  \n\ufeff,Id Tlf\n\n0,2\n0,3,sobra\n")
    write(tmp_path / "m" / "c.csv", ",Id Tlf,,\n0,4,,\n0,5,,,\n0,6,x,y,z\n")
    write(tmp_path / "m" / "d.csv", "")
    write(tmp_path / "m" / "e.csv", '"Id Tlf","Canal"\n"7","a,b"\n8\n')
    rows, errors, rejected = monthly_extracts.load_month_lines(spark, str(tmp_path), "m")
    assert sorted((r["Id Tlf"], r.Canal) for r in rows.collect()) == [(1, None), (2, None), (4, None), (5, None), (7, "a,b"), (8, None)]
    assert sorted((r.archivo_origen, r.linea) for r in rejected.collect()) == [("b {x}*.csv", 6), ("c.csv", 4)]
    good, bad = monthly_extracts.load_month(spark, str(tmp_path), "m")
    assert sorted(r["Id Tlf"] for r in good.collect()) == [1, 7, 8] and bad.count() == 2


def test_lines_with_and_without_quotes_have_the_same_fields(spark, tmp_path):
    lines = ['7,a,,b', '"7","a","","b"', '"7",a,"",b,', '7,"a,b",,""', '7', '7, a ,\\,"b""', ',,,', '7,a,,b,x', '7,a,,b,"x"']
    write(tmp_path / "m" / "a.csv", "Id Tlf,Canal,,Adquiriente\n" + "\n".join(lines) + "\n")
    write(tmp_path / "m" / "b.csv", 'Adquiriente,"Canal","Id Tlf"\nb,a,7\n"b","a","7"\n')
    rows, _, rejected = monthly_extracts.load_month_lines(spark, str(tmp_path), "m")
    got = sorted(((r["Id Tlf"], r.Canal, r.Adquiriente) for r in rows.collect()), key=repr)
    seven, odd = (7, "a", "b"), [(7, "a,b", None), (7, None, None), (7, " a ", 'b"'), (None, None, None)]
    assert [g for g in got if g == seven] == [seven] * 5 and len(got) == 9 and all(o in got for o in odd)
    assert sorted(r.linea for r in rejected.collect()) == [9, 10]
    target = work_dir(spark, "months")
    mended = rejected.withColumn("texto", F.regexp_replace("texto", ',"?x"?$', ""))
    one = mended.limit(1).select("mes_origen", F.lit("c.csv").alias("archivo_origen"), "linea", "motivo", F.lit("b,7").alias("texto"), F.lit('"Adquiriente",Id Tlf').alias("encabezado"))
    without = one.withColumn("encabezado", F.lit(None).cast("string"))
    assert monthly_extracts.replay_lines(spark, mended.union(one).union(without), target).count() == 0
    got = [(r["Id Tlf"], r.Canal, r.Adquiriente) for r in monthly_extracts.read_consolidated(spark, target).collect()]
    assert sorted(got, key=repr) == sorted([seven, seven, (7, None, "b"), (None, None, None)], key=repr)


def test_no_line_is_parsed_again_for_every_field(spark, tmp_path):
    write(tmp_path / "m" / "a.csv", ",Id Tlf,Canal\n0,1,x\n")
    for rows in monthly_extracts.split_bad_lines(monthly_extracts.read_month(spark, str(tmp_path), "m")):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_csv") <= 4
