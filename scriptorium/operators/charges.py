"""Keyword analysis of charge sheets: required elements, doubtful evidence, formal defects and the strategy that follows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# For each required element how many of its terms must stand in the text, and the terms.
ELEMENTS = {
    "identity": (2, ("imputado", "acusado", "nombre completo", "dni", "identidad nacional", "mayor de edad", "vecino de", "domicilio", "nacionalidad hondureña")),
    "facts": (3, ("fecha", "hora", "lugar", "circunstancias", "hecho", "hechos que se atribuyen", "día", "mes del año", "barrio", "colonia", "municipio", "departamento")),
    "offence": (2, ("delito de", "tipificado en", "artículo", "decreto", "código penal", "constituye el delito", "configura el tipo penal", "encuadra en")),
    "evidence": (1, ("prueba", "indicio", "evidencia", "testigo", "perito", "dictamen", "certificación", "acta", "informe", "declaración", "consta")),
    "role": (1, ("autor", "coautor", "cómplice", "instigador", "participó en", "ejecutó", "realizó", "llevó a cabo", "intervino", "contribuyó")),
    "petition": (1, ("solicita", "solicito", "pide", "se pide", "petición", "auto de formal procesamiento", "requerimiento", "comparecencia")),
    "custody": (
        1,
        ("peligro de fuga", "periculum", "arraigo", "domicilio conocido", "obstaculización", "obstrucción", "destrucción de prueba", "influencia en testigos", "antecedentes penales", "medida cautelar", "prisión preventiva", "garantizar la presencia"),
    ),
}
# An alert or defect needs one term of the first list and none of the second.
ALERTS = {
    "confession": (("confesión", "confesó", "admitió"), ("ante el juez", "juzgado", "presencia del juez")),
    "search": (("allanamiento", "registro", "incautación"), ("orden judicial", "autorización judicial", "flagrancia")),
    "interception": (("interceptación", "escucha", "comunicaciones", "llamadas"), ("autorización", "judicial")),
}
DEFECTS = {
    "abstract_gravity": (("gravedad del delito", "pena elevada", "pena alta"), ("peligro de fuga", "antecedentes penales", "arraigo insuficiente", "riesgo de obstrucción")),
    "collective": (("todos", "los imputados", "los encausados", "todos ellos"), ("autor principal", "coautor", "cómplice", "instigador")),
}
DATED = r"[0-9]{1,2}\s+de\s+[A-Za-z0-9_]+\s+de\s+[0-9]{4}|[0-9]{2}[/-][0-9]{2}[/-][0-9]{4}"
NULLITY, NO_ACTION, CUSTODY, DISMISSAL, TRIAL = "Nulidad de Actuaciones", "Excepción de Falta de Acción", "Oposición a Medida Cautelar", "Sobreseimiento Definitivo", "Defensa de Fondo — Preparar Juicio Oral"
SHORTEST = 50


def named() -> dict[str, str]:
    """A column name for each term of any list, so that each is looked for once."""
    lists = [terms for _, terms in ELEMENTS.values()] + [terms for pair in (ALERTS | DEFECTS).values() for terms in pair]
    return {t: f"_t{i}" for i, t in enumerate(dict.fromkeys(t for terms in lists for t in terms))}


def analysed(df: DataFrame, text_column: str) -> DataFrame:
    """df with too_short, a flag for each element, alert and defect, missing, complies and strategy; found maps elements to their terms.

    Texts of under SHORTEST characters, and null texts, are not analysed: their flags and missing are null, they do not comply, and the
    strategy is the last one. A text without a date counts as one whose prosecution may have lapsed.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    short = F.length(F.trim(text)) < SHORTEST
    asked = lambda c: F.when(~F.col("too_short"), c)
    of = named()
    # The list of one element: a generator keeps the next projection from being folded into this one, so the text is lowered once.
    rows = df.withColumns({"too_short": short, "undated": F.when(~short, ~text.rlike(DATED))})
    rows = rows.withColumn("_low", F.explode(F.array(F.lower(text))))
    rows = rows.withColumn("_terms", F.explode(F.array(F.struct(*[F.contains("_low", F.lit(t)).alias(c) for t, c in of.items()])))).drop("_low")
    flag = lambda t: F.col(f"_terms.{of[t]}")
    some = lambda terms: reduce(or_, map(flag, terms))
    found = F.create_map(*[x for name, (_, terms) in ELEMENTS.items() for x in (F.lit(name), F.array_compact(F.array(*[F.when(flag(t), t) for t in terms])))])
    number = lambda terms: sum((flag(t).cast("int") for t in terms), F.lit(0))
    rows = rows.withColumns({"found": asked(found)} | {name: asked(number(terms) >= least) for name, (least, terms) in ELEMENTS.items()} | {name: asked(some(yes) & ~some(no)) for name, (yes, no) in (ALERTS | DEFECTS).items()})
    rows = rows.drop("_terms")
    count = lambda names, value: sum((F.when(F.col(n) == value, 1).otherwise(0) for n in names), F.lit(0))
    rows = rows.withColumns({"missing": asked(count(ELEMENTS, False)), "complies": ~F.col("too_short") & (count(ELEMENTS, False) + count([*DEFECTS, "undated"], True) == 0)})
    strategy = (
        F.when(F.col("too_short"), TRIAL)
        .when(count(ALERTS, True) > 0, NULLITY)
        .when(F.col("missing") >= 3, NO_ACTION)
        .when(~F.col("facts") & (~F.col("role") | F.col("collective")), NULLITY)
        .when((~F.col("custody") | F.col("abstract_gravity")) & (F.col("missing") <= 1), CUSTODY)
        .when(F.col("undated"), DISMISSAL)
        .otherwise(TRIAL)
    )
    return rows.withColumn("strategy", strategy)
