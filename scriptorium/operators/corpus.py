"""Corpus ingestion: completeness, rules in order, review states and moderation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vectors as V
from scriptorium.operators import articles as A

# States, roles and thresholds.
LEGAL_STATES = ("vigente", "derogado", "reformado", "pendiente_verificacion")
REVIEWERS = ("abogado_revisor_senior", "propietario_despacho")
MIN_SCORE = 0.6


def completeness(here: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Rows of each key on both sides, and whether the load is complete."""
    a = here.groupBy(key).agg(F.count("*").alias("here"))
    b = loaded.groupBy(key).agg(F.count("*").alias("loaded"))
    both = a.join(b, key, "full_outer").fillna(0, ["here", "loaded"])
    return both.withColumn("complete", F.col("loaded") >= F.col("here"))


def gaps(df: DataFrame, key: str, number: str) -> DataFrame:
    """The numbers from 1 to the largest that a key lacks, as (key, missing)."""
    most = df.groupBy(key).agg(F.max(number).alias("most")).where("most >= 1")
    wanted = most.select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("most").cast("long"))).alias("missing"))
    return wanted.join(df.select(key, F.col(number).cast("long").alias("missing")), [key, "missing"], "left_anti")


def completion(df: DataFrame, key: str, pending: Column) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(pending).alias("pending"))
    done = F.col("total") - F.col("pending")
    return counts.withColumns({"done": done, "percent": F.round(100.0 * done / F.col("total")).cast("int")})


def known_by_hash(rows: DataFrame, corpus: DataFrame, content: str) -> DataFrame:
    """rows with known: whether the corpus has the same content."""
    have = corpus.select(F.sha2(content, 256).alias("_hash")).distinct().withColumn("_known", F.lit(True))
    return rows.withColumn("_hash", F.sha2(content, 256)).join(have, "_hash", "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_hash", "_known")


def numeric_places(df: DataFrame, key: str, width: int = 10_000) -> DataFrame:
    """df with place, the rank (from 1) of each key, a number as text, in numeric order; keys are distinct.

    Keys fall into ranges of width numbers. Ranges are ranked apart, each after the counts of those below it, so no task sorts all.
    """
    ranged = df.withColumn("_number", F.col(key).cast("long")).withColumn("_range", F.floor(F.col("_number") / width))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    below = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_below"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_number"))
    return ranged.join(below, "_range").withColumn("place", F.col("_below") + own).drop("_number", "_range", "_below")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def matters(df: DataFrame, key: str, matter: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count_distinct(matter).alias("n_matters"))
    return counts.withColumn("mixed", F.col("n_matters") > 1)


def blank(column: str) -> Column:
    return T.trimmed(F.coalesce(column, F.lit(""))) == ""


# The fields that a package must state.
REQUIRED = ("autoridad", "decreto", "publicacion", "materia", "estado", "checksum", "responsable")


def missing_fields() -> Column:
    """The names of the required fields that a package lacks, comma-joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in REQUIRED])), ",")


def package_articles(packages: DataFrame) -> DataFrame:
    """norm_id, seq, num_articulo and contenido of every article in the packages' normalised texts."""
    return A.segmented(packages.select("norm_id", T.normalised(F.col("texto")).alias("text")))


def rules(packages: DataFrame, articles: DataFrame, corpus_hashes: DataFrame, detected: DataFrame | None = None) -> DataFrame:
    """packages with what each rule looks at, counted over their articles (norm_id, num_articulo, contenido).

    packages: norm_id, texto, url, approved_by and the REQUIRED fields. corpus_hashes: hash, the SHA-256 of contents held already.
    detected: norm_id and materia found in a package by other means; its declared one is always among them.
    """
    content = F.col("contenido")
    held = articles.withColumn("hash", F.sha2(content, 256))
    known = corpus_hashes.select("hash").distinct().withColumn("known", F.lit(True))
    counts = held.join(known, "hash", "left").groupBy("norm_id").agg(
        F.count("*").alias("n_articles"), F.count_if(blank("contenido")).alias("n_empty"), (F.count("*") - F.size(F.collect_set("num_articulo"))).alias("n_repeated"),
        F.count_if(~F.coalesce(F.col("num_articulo").rlike("^[0-9]+$"), F.lit(False))).alias("n_not_numeric"), F.count_if(F.coalesce("known", F.lit(False))).alias("n_known"), F.count_if(T.has_private_data(content)).alias("n_private"),
        F.min_by("num_articulo", "seq").alias("first_number"), F.collect_set("num_articulo").alias("numbers"),
    )
    numbers = ("n_articles", "n_empty", "n_repeated", "n_not_numeric", "n_known", "n_private")
    declared = packages.select("norm_id", "materia")
    seen = declared if detected is None else declared.union(detected.select("norm_id", "materia"))
    found = seen.where(~blank("materia")).groupBy("norm_id").agg(F.count_distinct("materia").alias("n_matters"))
    state = F.coalesce(F.col("estado"), F.lit(""))
    # What a package says by itself comes before the joins, so that its text is shuffled only for callers who ask for it.
    own = packages.withColumns(
        {
            "received": ~blank("texto"), "missing": missing_fields(), "identified": ~(blank("url") & blank("autoridad")), "known_state": state.isin(*LEGAL_STATES),
            "checksum_matches": F.coalesce(F.col("checksum") == F.sha2("texto", 256), F.lit(False)),
        }
    )
    joined = own.join(counts, "norm_id", "left").join(found, "norm_id", "left").fillna(0, [*numbers, "n_matters"])
    findable = F.coalesce(F.array_contains("numbers", F.col("first_number")), F.lit(False))
    return joined.withColumn("findable", findable).drop("numbers")


#: The steps of an ingestion in order; the ones without a condition only record that they were passed.
STEPS = (
    ("reception", lambda: F.col("received")),
    ("hash", None),
    ("manifest", lambda: (F.col("missing") == "") & F.col("identified") & F.col("known_state") & F.col("checksum_matches")),
    ("extraction", None),
    ("normalisation", None),
    ("articles", lambda: (F.col("n_empty") == 0) & (F.col("n_articles") > 0)),
    ("headings", None),
    ("duplicates", lambda: (F.col("n_repeated") == 0) & (F.col("n_not_numeric") == 0) & (F.col("n_known") == 0)),
    ("metadata", lambda: F.col("n_matters") <= 1),
    ("private_data", lambda: F.col("n_private") == 0),
    ("jsonl", None),
    ("staging", None),
    ("embeddings", None),
    ("benchmark", lambda: F.col("findable")),
    ("approval", lambda: ~blank("approved_by")),
    ("alias", None),
)


def first_rejection(ruled: DataFrame) -> DataFrame:
    """rules() with stopped_at (the number of the step that fails, from 1), rejected_by (its first rule that fails) and accepted."""
    stopped = F.coalesce(*[F.when(~passes(), F.lit(i)) for i, (_, passes) in enumerate(STEPS, 1) if passes is not None])
    reason = F.coalesce(
        F.when(~F.col("received"), "no_text"), F.when(F.col("missing") != "", "manifest_incomplete"), F.when(~F.col("identified"), "source_unknown"), F.when(~F.col("known_state"), "state_unknown"),
        F.when(~F.col("checksum_matches"), "checksum"), F.when(F.col("n_empty") > 0, "empty_articles"), F.when(F.col("n_articles") == 0, "no_articles"), F.when(F.col("n_repeated") > 0, "repeated_numbers"),
        F.when(F.col("n_not_numeric") > 0, "numbers_not_numeric"), F.when(F.col("n_known") > 0, "known_content"), F.when(F.col("n_matters") > 1, "mixed_matters"), F.when(F.col("n_private") > 0, "private_data"),
        F.when(~F.col("findable"), "benchmark"), F.when(blank("approved_by"), "not_approved"),
    )
    return ruled.withColumns({"stopped_at": stopped, "rejected_by": reason, "accepted": reason.isNull()})


def step_log(rejected: DataFrame) -> DataFrame:
    """One row for each step that a package of first_rejection() came to: number, step and result (ok or rejected)."""
    steps = F.array(*[F.struct(F.lit(i).alias("number"), F.lit(name).alias("step")) for i, (name, _) in enumerate(STEPS, 1)])
    taken = rejected.select("norm_id", "stopped_at", F.inline(F.slice(steps, 1, F.coalesce("stopped_at", F.lit(len(STEPS))))))
    return taken.select("norm_id", "number", "step", F.when(F.col("number") == F.col("stopped_at"), "rejected").otherwise("ok").alias("result"))


def jsonl(rejected: DataFrame, articles: DataFrame) -> DataFrame:
    """One JSON line for each article of the packages that came as far as the output step."""
    at = next(i for i, (name, _) in enumerate(STEPS, 1) if name == "jsonl")
    passed = rejected.where(F.coalesce(F.col("stopped_at") > at, F.lit(True))).select("norm_id", "decreto", "materia", "autoridad", "estado")
    rows = articles.join(passed, "norm_id")
    return rows.select("norm_id", "seq", F.to_json(F.struct("norm_id", "num_articulo", "contenido", "decreto", "materia", "autoridad", "estado", F.sha2("contenido", 256).alias("hash"))).alias("line"))


def promotions(attempts: DataFrame) -> DataFrame:
    """Attempts to raise a review state by one step; the last two steps need one of the REVIEWERS. Every attempt gets a row."""
    level = lambda c: F.substring(c, 2, 9).cast("int")
    outcome = F.when(level("estado_destino") != level("estado_origen") + 1, "not_next").when(F.col("estado_destino").isin("V4", "V5") & ~F.col("rol").isin(*REVIEWERS), "role_missing").otherwise("promoted")
    return attempts.withColumns({"outcome": outcome, "shown": F.col("estado_destino").isin("V4", "V5"), "searchable": F.col("estado_destino").isin("V3", "V4", "V5")})


def moderated(rows: DataFrame, auto_approve: bool = False) -> DataFrame:
    """rows (pii, score, legit, third) with the decision. A null score means that the review failed."""
    failed = F.col("score").isNull()
    any_pii = F.col("pii") | (F.col("third") & ~failed)
    decision = F.when(failed, "en_revision").when(~F.col("legit"), "rechazado").when(any_pii | (F.col("score") < MIN_SCORE) | F.lit(not auto_approve), "en_revision").otherwise("aprobado")
    return rows.withColumns({"decision": decision, "pii": any_pii})


# The lengths that a contribution and a template's original may have.
SHORTEST, LONGEST, SHORTEST_TEMPLATE = 100, 100_000, 80


def contributions(docs: DataFrame, verdicts: DataFrame, auto_approve: bool = False) -> DataFrame:
    """docs (doc_id, content, materia, tipo_documento) with error (too_short or too_long) or, for the rest, what is recorded.

    verdicts: doc_id, score, legit, third and inferred (the matter), as a reviewer gave them; without a row, the review failed. The
    record holds the anonymised content, the matter, pii and the decision of moderated(), whatever it is.
    """
    length = F.length(T.trimmed(F.coalesce("content", F.lit(""))))
    error = F.when(length < SHORTEST, "too_short").when(F.length("content") > LONGEST, "too_long")
    held = docs.withColumn("error", error).join(verdicts, "doc_id", "left")
    held = held.withColumns({"pii": T.has_structured(F.col("content")), "legit": F.coalesce("legit", F.lit(False)), "third": F.coalesce("third", F.lit(False)), "anonymised": T.anonymised(F.col("content")), "materia": F.coalesce("materia", "inferred")})
    recorded = F.col("error").isNull()
    rows = moderated(held, auto_approve)
    return rows.withColumns({c: F.when(recorded, F.col(c)) for c in ("decision", "pii", "anonymised", "materia", "score")}).drop("inferred", "legit", "third")


def contribution_chunks(recorded: DataFrame, provider: V.Provider) -> DataFrame:
    """The chunks of approved contributions with their vectors; their ids are the document's and a number of three digits."""
    approved = recorded.where("decision = 'aprobado'").select("doc_id", "materia", "tipo_documento", F.col("anonymised").alias("text"))
    rows = A.chunk_ids(A.chunks_by_paragraph(approved), "doc_id")
    held = rows.select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("documento_id"), "materia", "tipo_documento", F.col("chunk").alias("contenido"))
    return V.embedded(held, "contenido", provider)


def generated_templates(originals: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """originals (key, text) with the template that a model's answer holds, or the error for which there is none.

    answers: key and answer, a text around one JSON object with tipo_instrumento, titulo, contenido_plantilla and variables. An answer
    without one, or none, is a failure; a template with personal data left in it is discarded.
    """
    form = "tipo_instrumento string, titulo string, contenido_plantilla string, variables array<string>"
    block = F.regexp_extract("answer", r"(?s)\{.*\}", 0)
    held = originals.join(answers.select(key, F.from_json(block, form).alias("_t")), key, "left").select(*originals.columns, "_t.*")
    short = F.length(T.trimmed(F.coalesce("text", F.lit("")))) < SHORTEST_TEMPLATE
    error = F.when(short, "too_short").when(F.col("contenido_plantilla").isNull(), "failed").when(T.has_residue(F.col("contenido_plantilla")), "private_data")
    held = held.withColumn("error", error)
    shown = {c: F.when(F.col("error").isNull(), F.col(c)) for c in ("tipo_instrumento", "titulo", "contenido_plantilla", "variables")}
    return held.withColumns({**shown, "verificado_sin_pii": F.col("error").isNull()})


def to_load(here: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """The rows of the keys whose load is not complete yet, for a load that resumes."""
    return here.join(completeness(here, loaded, key).where("not complete").select(key), key, "left_semi")


def library_rows(chunks: DataFrame, collection: str, article_keys: tuple[str, ...], source_keys: tuple[str, ...]) -> DataFrame:
    """chunks (chunk_id, document, metadata as a map, embedding) as rows of the library, with short metadata that stays valid JSON."""
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    return chunks.select(
        T.without_nul(F.concat(F.lit(collection + ":"), "chunk_id")).alias("id"), F.lit(collection).alias("coleccion"), T.without_nul(F.try_element_at(meta, F.lit("materia"))).alias("materia"),
        T.without_nul(F.substring(F.coalesce("document", F.lit("")), 1, 8000)).alias("contenido"), T.first_key(meta, article_keys).alias("num_articulo"), T.first_key(meta, source_keys).alias("fuente"),
        T.without_nul(F.to_json(T.shortened(meta))).alias("metadata"), V.literal(F.col("embedding")).alias("embedding"),
    )


def availability(state: Column) -> dict[str, Column]:
    """For which uses a review state makes content available."""
    return {"professional": state.isin("V4", "V5"), "with_warning": state == "V3", "beta": state == "V4", "production": state == "V5"}


def unexpected_counts(df: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """The keys whose number of rows is not the expected one (key, expected), keys of one side only included."""
    both = df.groupBy(key).agg(F.count("*").alias("n")).join(expected, key, "full_outer").fillna(0, ["n", "expected"])
    return both.where("n <> expected")
