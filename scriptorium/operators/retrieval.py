"""Exact vector retrieval with filters, fusion, citations and context rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vectors as V
from scriptorium.operators.search import Index

CAP, TEMPLATE_CAP, IN_FORCE = 20, 10, 3
MAX_CITATIONS, CITATION_LENGTH = 5, 600
TEMPLATE_SIMILARITY = 0.75
QUERY_BLOCK, MOST_SENT = 64, 256


def optional(df: DataFrame, **wanted) -> DataFrame:
    """df with an equality predicate for each argument that is not None."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def scored(df: DataFrame, query: Sequence[float], column: str = "embedding") -> DataFrame:
    return df.where(F.col(column).isNotNull()).withColumn("similarity", V.cosine_similarity(F.col(column), V.vector(query)))


def nearest(df: DataFrame, query: Sequence[float], k: int, cap: int = CAP, threshold: float | None = None, key: str = "id") -> DataFrame:
    """The k rows (cap at most) most similar to query, ties by key. Each partition keeps k rows, so nothing is sorted as a whole."""
    df = scored(df, query)
    if threshold is not None:
        df = df.where(F.col("similarity") >= threshold)
    return df.orderBy(F.desc("similarity"), key).limit(min(k, cap))


def search_library(corpus: DataFrame, query: Sequence[float], coleccion: str | None = None, materia: str | None = None, k: int = 5, in_force: bool | None = None) -> DataFrame:
    """Top-k of a collection, optionally of one matter or of statutes in force only."""
    return nearest(optional(corpus, coleccion=coleccion, materia=materia, es_norma_vigente=True if in_force else None), query, k)


def search_threshold(corpus: DataFrame, query: Sequence[float], coleccion: str | None = None, k: int = 5, threshold: float = 0.3) -> DataFrame:
    return nearest(optional(corpus, coleccion=coleccion), query, k, threshold=threshold)


def search_community(chunks: DataFrame, moderated: DataFrame, query: Sequence[float], materia: str | None = None, k: int = 5, tipo: str | None = None) -> DataFrame:
    """Top-k of the chunks whose document is approved, optionally of one matter or kind of document."""
    approved = moderated.where("estado_moderacion = 'aprobado'").select(F.col("doc_id").alias("documento_id"))
    return nearest(optional(chunks, materia=materia, tipo_documento=tipo).join(approved, "documento_id"), query, k)


def search_templates(templates: DataFrame, query: Sequence[float], tipo: str | None = None, k: int = 3) -> DataFrame:
    """Top-k of the templates that were verified to hold no personal data."""
    return nearest(optional(templates.where("verificado_sin_pii = true"), tipo_instrumento=tipo), query, k, cap=TEMPLATE_CAP, key="vec_id")


def fused(corpus: DataFrame, query: Sequence[float], coleccion: str | None = None, materia: str | None = None, k: int = 5, extra: int = IN_FORCE) -> DataFrame:
    """Top-k, then those of the top statutes in force that it lacks, without the fragments that hold anonymising marks; stage is 1 or 2.

    Fragments go after the searches, so that fewer than k may stay; that is what keeps unclean ones from being replaced by worse ones.
    """
    first = search_library(corpus, query, coleccion, materia, k).withColumn("stage", F.lit(1))
    second = search_library(corpus, query, coleccion, materia, extra, in_force=True).withColumn("stage", F.lit(2))
    both = first.unionByName(second.join(first.select("id"), "id", "left_anti").select(second.columns))
    return both.where(~T.contaminated(F.col("contenido")))


# The collection that each route searches, for civil and for criminal questions; criminal ones stay within their matter.
CIVIL = {"A": "procedimental", "B": "normativos", "C": "normativos"}
CRIMINAL = {"A": "normativos", "B": "normativos", "C": "normativos"}
CRIMINAL_MATTER, PROCEDURAL, PROCEDURAL_HITS = "01_PENAL", "procedimental", 3


def routed(asked: DataFrame, civil: dict = CIVIL, criminal: dict = CRIMINAL) -> DataFrame:
    """The searches of each question (route, criminal): pass, collection, matter (null: any) and k; a civil C makes a second one."""
    of = lambda kinds: F.coalesce(*[F.when(F.col("route") == r, F.lit(c)) for r, c in kinds.items()], F.lit(None).cast("string"))
    main = F.when(F.col("criminal"), of(criminal)).otherwise(of(civil))
    search = lambda n, c, m, k: F.struct(F.lit(n).alias("pass"), c.alias("coleccion"), m.alias("materia"), F.lit(k).alias("k"))
    first = F.when(main.isNotNull(), search(1, main, F.when(F.col("criminal"), CRIMINAL_MATTER), 5))
    second = F.when((F.col("route") == "C") & ~F.col("criminal"), search(2, F.lit(PROCEDURAL), F.lit(None).cast("string"), PROCEDURAL_HITS))
    return asked.select("*", F.explode(F.array_compact(F.array(first, second))).alias("_search")).select("*", "_search.*").drop("_search")


def route_search(corpus: DataFrame, query: Sequence[float], route: str, criminal: bool = False, civil: dict = CIVIL, criminal_kinds: dict = CRIMINAL) -> DataFrame:
    """What one question of a route retrieves: its collection's fused search and, for a civil C, the procedural one behind it.

    Both lists follow each other as they are, so a fragment that both find stands twice; column pass is 1 or 2.
    """
    main = (criminal_kinds if criminal else civil).get(route)
    if main is None:
        return fused(corpus, query).where(F.lit(False)).withColumn("pass", F.lit(1))
    found = fused(corpus, query, main, CRIMINAL_MATTER if criminal else None).withColumn("pass", F.lit(1))
    if route == "C" and not criminal:
        found = found.unionAll(fused(corpus, query, PROCEDURAL if civil is CIVIL else civil["A"], k=PROCEDURAL_HITS).withColumn("pass", F.lit(2)))
    return found


def nearest_of_each(corpus: DataFrame, queries: DataFrame, k: int, key: str = "id") -> DataFrame:
    """Top-k for each row of queries (query_id, query), a stated set that meets the corpus in blocks of about QUERY_BLOCK vectors.

    Each corpus row scores a block where it stands and only k rows a partition and query are shuffled. Up to MOST_SENT queries are
    sent to every executor; more of them meet only the blocks of an index that may hold their rows, and rows without direction are left out.
    """
    n = queries.count()
    if n > MOST_SENT:
        return Index(corpus, key).search(queries, k)
    block = F.pmod(F.xxhash64("query_id"), F.lit(n // QUERY_BLOCK + 1))
    packed = queries.groupBy(block.alias("block")).agg(F.collect_list(F.struct("query_id", "query")).alias("queries"))
    rows = corpus.crossJoin(F.broadcast(packed)).select(key, "embedding", F.explode("queries").alias("q"))
    similar = rows.select("q.query_id", key, V.cosine_similarity(F.col("embedding"), F.col("q.query")).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), key))
    return similar.withColumn("rank", rank).where(F.col("rank") <= k)


def first_of_key(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The first row of each key in the given order, and of these the first n."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank").orderBy(order).limit(n)


def citations(fragments: DataFrame, order: str = "pos", n: int = MAX_CITATIONS) -> DataFrame:
    """Statutes in force, one for each article and source in input order, long texts cut, n at most."""
    held = fragments.where("es_norma_vigente = true").withColumn("_article", F.coalesce("num_articulo", F.lit("")))
    long = F.length("contenido") > CITATION_LENGTH
    cut = F.when(long, F.concat(F.substring("contenido", 1, CITATION_LENGTH), F.lit("…"))).otherwise(F.col("contenido"))
    kept = first_of_key(held, ["_article", "fuente"], order, n)
    return kept.select(order, F.col("num_articulo").alias("articulo"), cut.alias("texto"), "fuente", T.fragment_hash(F.col("contenido"), F.col("num_articulo"), F.col("fuente")).alias("hash"))


def context_label(in_force: Column, jurisdiction: Column, kind: Column) -> Column:
    """What a fragment may be used for, or null."""
    return (
        F.when(in_force, "NORMA VIGENTE HONDURAS")
        .when((jurisdiction != "") & (jurisdiction != "HN"), F.concat(F.lit("DOCTRINA/JURISPRUDENCIA COMPARADA — "), jurisdiction))
        .when(kind.isin("sentencia", "doctrina"), "DOCTRINA/JURISPRUDENCIA — NO ES NORMA VIGENTE")
    )


def percentage(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def numbered_blocks(rows: DataFrame, key: str, order: str, line: Column, between: str = "\n\n") -> DataFrame:
    """One text for each key, named block: a line for each of its rows in order; line may use n, the row's number from 1.

    The rows of one key are the few that a question retrieved (at most CAP + IN_FORCE).
    """
    lines = rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).select(key, "n", line.alias("line"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return lines.groupBy(key).agg(F.array_join(listed, between).alias("block"))


def community_blocks(found: DataFrame, key: str, order: str) -> DataFrame:
    """Contributions of users (kind, content), numbered."""
    return numbered_blocks(found, key, order, F.concat(F.lit("[Comunidad "), F.col("n").cast("string"), F.lit("] ("), F.col("kind"), F.lit(")\n"), F.col("content")))


def web_blocks(found: DataFrame, key: str, order: str) -> DataFrame:
    """Web results (title, domain, url, snippet), numbered."""
    head = F.concat(F.lit("[Web "), F.col("n").cast("string"), F.lit("] "), F.col("title"))
    fields = F.concat(F.lit("\n  Dominio: "), F.col("domain"), F.lit("\n  URL:     "), F.col("url"), F.lit('\n  Fragmento: "'), F.col("snippet"), F.lit('"'))
    return numbered_blocks(found, key, order, F.concat(head, fields))


def template_blocks(found: DataFrame, key: str, order: str) -> DataFrame:
    """Templates (title, similarity, variables, content) of TEMPLATE_SIMILARITY or more, numbered, with the variables to fill in."""
    head = F.concat(F.lit("[PLANTILLA "), F.col("n").cast("string"), F.lit("] "), F.col("title"), F.lit(" (similitud: "), percentage(F.col("similarity")), F.lit(")\n"))
    line = F.concat(head, F.lit("Variables a completar: "), F.array_join("variables", ", "), F.lit("\n\n"), F.col("content"))
    return numbered_blocks(found.where(F.col("similarity") >= TEMPLATE_SIMILARITY), key, order, line, "\n\n---\n\n")


def attachment_blocks(attachments: DataFrame, questions: DataFrame, key: str, order: str) -> DataFrame:
    """What a question with attachments (filename, text) sends: a block for each attachment in order, then the question (content).

    A question without attachments is sent as it is; attachments without words beside them stand alone.
    """
    line = F.concat(F.lit("📎 **Documento adjunto: "), "filename", F.lit("**\n```\n"), "text", F.lit("\n```"))
    held = questions.join(numbered_blocks(attachments, key, order, line), key, "left")
    content = F.coalesce("content", F.lit(""))
    both = F.concat("block", F.lit("\n\n---\n\n**Consulta del usuario:**\n"), content)
    sent = F.when(F.col("block").isNull(), content).when(T.trimmed(content) == "", F.col("block")).otherwise(both)
    return held.select(key, sent.alias("sent"))


def abstentions(questions: DataFrame, found: DataFrame, key: str, code: str = "CORPUS_EVIDENCE_NOT_FOUND") -> DataFrame:
    """questions (with required) and n_fragments, and the code with which one that needs evidence and has none is answered, else null."""
    counts = found.groupBy(key).agg(F.count("*").alias("n_fragments"))
    held = questions.join(counts, key, "left").fillna(0, ["n_fragments"])
    return held.withColumn("code", F.when(F.col("required") & (F.col("n_fragments") == 0), code))


def context_blocks(fragments: DataFrame, key: str, order: str, content: str = "contenido") -> DataFrame:
    """One text for each key: its fragments in order, numbered, with article, label and relevance.

    Fragments of one key are the few that a question retrieved (at most CAP + IN_FORCE).
    """
    number = F.row_number().over(Window.partitionBy(key).orderBy(order))
    label = context_label(F.col("es_norma_vigente"), F.col("jurisdiccion"), F.col("fuente_tipo"))
    head = F.concat(
        F.lit("[FRAGMENTO "), number.cast("string"), F.coalesce(F.concat(F.lit(" — Art. "), F.col("num_articulo")), F.lit("")),
        F.coalesce(F.concat(F.lit(" ["), label, F.lit("]")), F.lit("")), F.lit(" | relevancia: "), percentage(F.col("relevancia")), F.lit("]"),
    )
    lines = fragments.select(key, number.alias("n"), F.concat(head, F.lit("\n"), T.trimmed(F.col(content))).alias("line"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return lines.groupBy(key).agg(F.array_join(listed, "\n\n").alias("block"))
