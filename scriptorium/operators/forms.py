"""Forms as JSON texts, checked against rules that are data.

A rule is a row: where a field lies, of which kind it is, and its bounds. A schema is compiled into columns of one expression each, so a table of
forms is checked where it lies, without a parser of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Field(NamedTuple):
    """One field. path: its names, joined by dots. kind: number, boolean, text, date, list or object.

    low and high bound a number's value, a text's length in UTF-16 units, or a list's number of items. items: the kind of a list's items, or
    the fields of each item.
    """

    path: str
    kind: str
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()
    optional: bool = False
    items: str | tuple[Field, ...] | None = None


# The choices, fields and bounds of the three forms.
OFFENCES = (
    "Homicidio simple", "Asesinato", "Femicidio", "Lesiones", "Violación", "Abuso sexual", "Robo", "Robo agravado", "Hurto", "Extorsión", "Secuestro", "Estafa",
    "Falsificación de documentos", "Peculado", "Cohecho", "Tráfico de drogas", "Posesión de drogas", "Lavado de activos", "Trata de personas", "Crimen organizado", "Otro",
)
DEFENCES = (
    "Negación total — Los hechos no ocurrieron como los describe el fiscal",
    "Justificación — Legítima defensa (Art. 23.1 CP)",
    "Justificación — Estado de necesidad (Art. 23.2 CP)",
    "Justificación — Cumplimiento del deber (Art. 24.1 CP)",
    "Inculpabilidad — Error de tipo (Art. 27 CP)",
    "Inculpabilidad — Error de prohibición (Art. 28 CP)",
    "Inculpabilidad — Inimputabilidad (Art. 23.3 CP)",
    "Atipicidad — La conducta no encuadra en el tipo penal imputado",
    "Falta de prueba — Insuficiencia probatoria del fiscal",
    "Atenuación — Menor culpabilidad (pedir pena mínima)",
)
EVIDENCE = ("Testifical — presencial", "Testifical — referencial", "Pericial", "Documental", "Material", "Digital")
MEASURES = (
    Field("delito_imputado", "text", choices=OFFENCES),
    Field("pena_maxima_abstracta_anos", "number", 0, 40),
    Field("arraigo", "object"),
    Field("arraigo.domicilio_fijo_conocido", "boolean"),
    Field("arraigo.empleo_o_actividad_economica", "boolean"),
    Field("arraigo.familia_en_honduras", "boolean"),
    Field("arraigo.anos_residencia_en_honduras", "number", 0),
    Field("arraigo.bienes_inmuebles_en_honduras", "boolean"),
    Field("peligro_procesal", "object"),
    Field("peligro_procesal.antecedentes_penales", "boolean"),
    Field("peligro_procesal.procesos_penales_pendientes", "boolean"),
    Field("peligro_procesal.fue_declarado_rebelde", "boolean"),
    Field("peligro_procesal.riesgo_destruccion_prueba", "boolean"),
    Field("peligro_procesal.riesgo_influencia_testigos_victimas", "boolean"),
    Field("peligro_procesal.oferta_de_fuga_documentada", "boolean"),
    Field("prohibicion_prision_preventiva", "object"),
    Field("prohibicion_prision_preventiva.mayor_60_anos", "boolean"),
    Field("prohibicion_prision_preventiva.mujer_embarazada_o_lactante", "boolean"),
    Field("prohibicion_prision_preventiva.enfermedad_terminal_o_grave", "boolean"),
)
CASE_THEORY = (
    Field("version_fiscal_hechos", "text", 50),
    Field("hechos_admitidos", "list", items="text"),
    Field("hechos_negados", "list", 1, items="text"),
    Field("hechos_alternativos", "list", optional=True, items="text"),
    Field("teoria_juridica_defensa", "text", choices=DEFENCES),
    Field(
        "prueba_defensa",
        "list",
        items=(
            Field("tipo", "text", choices=EVIDENCE),
            Field("descripcion", "text", 10),
            Field("disponible", "boolean"),
            Field("acredita_hecho", "text"),
            Field("controvierte_hecho_fiscal", "text", optional=True),
        ),
    ),
    Field("prueba_fiscal_debilidades", "list", optional=True, items="text"),
    Field("linea_tematica", "text", None, 200),
    Field("estrategia_fase_preparatoria", "text", optional=True),
    Field("estrategia_etapa_intermedia", "text", optional=True),
    Field("estrategia_juicio_oral", "text", optional=True),
)
LIMITATION = (
    Field("pena_maxima_del_delito_anos", "number", 0, 40),
    Field("fecha_comision_del_hecho", "date"),
    Field("hubo_acto_interruptivo", "boolean"),
    Field("fecha_ultimo_acto_interruptivo", "date", optional=True),
    Field("es_delito_imprescriptible", "boolean"),
)
#: A date is a day and a time with an offset or Z.
DATE = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)$"
#: What the type of a JSON value begins with, for each kind.
KINDS = {"number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)", "boolean": "^BOOLEAN", "text": "^STRING", "date": "^STRING", "list": "^ARRAY", "object": "^OBJECT"}


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(KINDS[kind]), F.lit(False))


def _problem(value: Column, rule: Field, parent: Column | None) -> Column:
    """The first thing that is wrong with a field's value (a variant, null if it is absent): missing, kind, choice, date or size; else null."""
    text = F.try_variant_get(value, "$", "string")
    if rule.kind == "number":
        size = F.try_variant_get(value, "$", "double")
    elif rule.kind == "list":
        size = F.size(F.try_variant_get(value, "$", "array<variant>"))
    else:
        size = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    wrong = F.when(value.isNull(), F.lit(None) if rule.optional else F.lit("missing")).when(~_is(value, rule.kind), "kind")
    if rule.choices:
        wrong = wrong.when(~text.isin(*rule.choices), "choice")
    if rule.kind == "date":
        day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
        wrong = wrong.when(~text.rlike(DATE) | day.isNull(), "date")
    if rule.low is not None:
        wrong = wrong.when(size < rule.low, "size")
    if rule.high is not None:
        wrong = wrong.when(size > rule.high, "size")
    return wrong if parent is None else F.when(_is(parent, "object"), wrong)


def _named(path: str, problem: Column) -> Column:
    return F.when(problem.isNotNull(), F.concat(F.lit(path + ": "), problem))


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _of_items(value: Column, rule: Field) -> Column:
    """What is wrong with the items of a list, told by their place."""
    items = F.when(_is(value, "list"), F.try_variant_get(value, "$", "array<variant>"))
    place = lambda i: F.concat(F.lit(f"{rule.path}["), i.cast("string"), F.lit("]"))
    wrong_kind = lambda i: F.concat(place(i), F.lit(": kind"))
    if isinstance(rule.items, str):
        return F.transform(items, lambda v, i: F.when(~_is(v, rule.items), wrong_kind(i)))

    def of_item(v: Column, i: Column) -> Column:
        own = [F.when(p.isNotNull(), F.concat(place(i), F.lit(f".{f.path}: "), p)) for f in rule.items for p in [_problem(_get(v, f.path), f, None)]]
        return F.when(_is(v, "object"), F.array(*own)).otherwise(F.array(wrong_kind(i)))

    return F.flatten(F.transform(items, of_item))


def problems(form: Column, schema: Sequence[Field]) -> Column:
    """What is wrong with a form (a variant), as texts "path: problem" in order of the schema; items of lists are told by their place."""
    found: list[Column] = []
    for rule in schema:
        value, above = _get(form, rule.path), rule.path.rpartition(".")[0]
        found.append(F.array(_named(rule.path, _problem(value, rule, _get(form, above) if above else None))))
        if rule.items is not None:
            found.append(F.coalesce(_of_items(value, rule), F.array().cast("array<string>")))
    return F.array_compact(F.concat(*found))


def checked_forms(df: DataFrame, column: str, schema: Sequence[Field]) -> DataFrame:
    """df with problems (texts, none for a form that may be used); a text that is no JSON object has the one problem "form: kind".

    A field that is absent is missing unless it is optional; one that is null is of the wrong kind, as it is for optional ones. Fields that the
    schema does not name are allowed. Of a missing object its own fields are not reported. A null text is no form.
    """
    form = F.try_parse_json(column)
    return df.withColumn("problems", F.when(_is(form, "object"), problems(form, schema)).otherwise(F.array(F.lit("form: kind"))))
