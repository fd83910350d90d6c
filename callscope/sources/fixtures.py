"""Derived tables: calls with known deadlines, observations, attachments, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2026-08-20"
FILL = "Leia todas as orientacoes gerais do programa antes de preparar os documentos exigidos pela comissao organizadora. "
PT = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
EN = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fanned_out(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def numbered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with ``__line``, the place of each row in the order in which its files are read."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # One file needs no name beside its rows' numbers.
    return fanned_out(rows.select("*", (at["row"] if len(rows.inputFiles()) == 1 else at).alias("__line")))


def fanned_out(df: DataFrame) -> DataFrame:
    """An input of fewer splits than cores is dealt out to all of them; a larger one stays as it is read.

    The row-wise text rules are bound by CPU, so a small file must not be one task.
    Column pruning reaches through the exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) == 1 and _lengths(df)[0] < SMALL else df


#: Bytes below which one input file is dealt out; bytes of narrow rows that feed one task of text rules.
SMALL, SHARE = 1 << 27, 1 << 20


def by_rows(df: DataFrame) -> DataFrame:
    """Narrow rows that text rules are worked out for, dealt out evenly: ``SHARE`` bytes of their files a task, at least a task a core.

    Few bytes of such a table stand for many rows and a file's row groups are not split, so as it
    is read a large table would come in as many long tasks as at a small size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, sum(_lengths(df)) // SHARE))


def _lengths(df: DataFrame) -> list[int]:
    """Bytes of each of a table's files."""
    context = df.sparkSession.sparkContext
    paths = map(context._jvm.org.apache.hadoop.fs.Path, df.inputFiles())
    return [p.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths]


#: Titles as pages have them: menus, calls, body text, markup; ``{n}`` is a row's number.
TITLES = (
    "Regimento interno da universidade", "Licitações e contratos do estado {n}", "Bolsas no exterior", "Como funciona o programa", "Atas da comissão de {n}",
    "Notícias", "Conselho Científico {n}", "internacional Islândia", "Graduação", "Editais abertos", "Formulários e modelos {n}", "Perguntas frequentes",
    "Edital {n}/2026 de pesquisa conjunta", "Chamada pública {n} de cooperação", "Programa de bolsas {n} para doutorado sanduíche", "Prêmio Jovem Cientista {n}",
    "GraduaçãoComo funciona o portal da universidade e seus cursos todos aqui {n}", "MareViva Chamada Transnacional Conjunta de Oceanos e Clima {n}",
    "Resultado da SeleçãoLista dos aprovados do processo nº {n} da universidade federal", "Termo de Cooperação {n}", "Termo aditivo {n} da cooperação",
    "Edital {n} de apoio à pesquisa aplicada Este edital abre inscrições para docentes", "Chamada {n} de mobilidade acadêmica Destinada a estudantes de mestrado",
    "Categoria: Chamada {n} de mobilidade", "em Pesquisadores e Professores Bolsa de estudos {n}", "• Prêmio anual {n}.", "Edital curto Este edital {n} fica",
    '<svg viewBox="0 0 1 1"><path d="M1 1"></svg>Chamada com ícone {n}', "Chamada {n} {color: red; margin: 0 0 0 0; padding: 1px} estilizada", "Bolsa {n}   com   espaços  —",
    "Chamada conjunta {n} de projetos de pesquisa em biodiversidade e clima. Pesquisadores das instituições do estado e de fora dele são convidados a enviar projetos",
    "Programa de intercâmbio {n} entre universidades parceiras | apoio a missões de curta duração no exterior para docentes e discentes | edição anual com muitas vagas",
    "Uma linha muito longa sem qualquer separador que sirva para cortar e que segue por mais de cento e dez caracteres sem terminar nunca {n}",
    "Inscrições {n} para o programa Inscrições abertas até outubro", "Apoio {n} a eventos Professores e pesquisadores podem se candidatar", "Curso {n} Com o objetivo de formar", "",
)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title): the titles above by turns."""
    every = F.array(*map(F.lit, TITLES))
    title = F.element_at(every, (F.col("p_partkey") % len(TITLES) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace(title, F.lit("{n}"), F.col("p_partkey").cast("string")).alias("title"))
    return rows


TITLES_SQL = "SELECT p_partkey AS id, replace(list_extract([" + ", ".join("'" + t.replace("'", "''") + "'" for t in TITLES) + f"], CAST(p_partkey % {len(TITLES)} + 1 AS BIGINT)), '{{n}}', CAST(p_partkey AS VARCHAR)) AS title FROM part"


def _calls(dmy: str, before: str, ymd: str, month, day: str, year: str, source: str, shift: str) -> str:
    return f"""
SELECT o_orderkey AS call_id, o_custkey % 16 AS source_no, o_orderkey % 8 AS v, d AS deadline,
  CASE o_orderkey % 8
    WHEN 0 THEN concat('Chamada de cooperacao internacional. Inscricoes ate ', {dmy}, '.')
    WHEN 1 THEN concat('International joint research call. Application deadline ', {ymd}, '.')
    WHEN 2 THEN concat('Edital de mobilidade academica. Inscricoes ate ', {day}, ' de ', {month(PT)}, ' de ', {year}, '.')
    WHEN 3 THEN concat('Research fellowship abroad. Apply by ', {month(EN)}, ' ', {day}, ', ', {year}, '.')
    WHEN 4 THEN concat('Previsao para abertura das inscricoes: ', {before}, '. {FILL}', 'Inscricoes ate ', {dmy}, '.')
    WHEN 5 THEN concat('Resultado final publicado em ', {dmy}, '.')
    WHEN 6 THEN concat('International grant. Status: forthcoming. Deadline ', {dmy}, '.')
    ELSE 'Programa internacional sem data. Inscricoes abertas.' END AS text
FROM (SELECT o_orderkey, o_custkey, {shift} AS d FROM {source}) AS o"""


CALLS_SQL = _calls("strftime(d, '%d/%m/%Y')", "strftime(d - 60, '%d/%m/%Y')", "strftime(d, '%Y-%m-%d')", lambda names: f"(['{"','".join(names)}'])[month(d)]", "CAST(day(d) AS VARCHAR)", "CAST(year(d) AS VARCHAR)", "orders", "CAST(o_orderdate AS DATE) + 9862")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _calls("date_format(d, 'dd/MM/yyyy')", "date_format(date_sub(d, 60), 'dd/MM/yyyy')", "date_format(d, 'yyyy-MM-dd')", lambda names: f"element_at(array('{"','".join(names)}'), month(d))", "CAST(day(d) AS STRING)", "CAST(year(d) AS STRING)", "{orders}", "date_add(CAST(o_orderdate AS DATE), 9862)")
    return spark.sql(sql, orders=by_rows(spark.read.parquet(f"{sf_dir}/orders.parquet")))


_OBSERVED = """
SELECT user_id AS key, run_no, status, event_id FROM (
  SELECT user_id, event_id, {diff} + 1 AS run_no,
    CASE event_type WHEN 'view' THEN 'aberto' WHEN 'click' THEN 'aberto' WHEN 'error' THEN 'encerrado' WHEN 'signup' THEN 'verificar' ELSE 'futuro' END AS status,
    row_number() OVER (PARTITION BY user_id, {diff} ORDER BY ts DESC, event_id DESC) AS place
  FROM {events}) AS e WHERE place = 1 AND user_id % 5 <> run_no"""
OBSERVED_SQL = _OBSERVED.format(diff="date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 15", events="events")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each key in each run: all days as runs of half a month, some keys absent from each."""
    return spark.sql(_OBSERVED.format(diff="datediff(CAST(ts AS DATE), DATE '2024-01-01') div 15", events="{events}"), events=table(spark, sf_dir, "events"))
