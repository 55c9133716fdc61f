"""Text expressions: detection, anonymising, redaction, normalising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and markers that decide what counts as a match.
ARTICLE_NUMBER = r"\bart(?:[ií]culo|\.)?\s*(\d+)\b"
MATTERS = (("01_PENAL", r"\b(penal|cpp|c[oó]digo\s+procesal\s+penal)\b"), ("02_CIVIL", r"\b(civil|cpc|c[oó]digo\s+procesal\s+civil)\b"))
INSTRUMENTS = (
    ("CODIGO_PROCESAL_PENAL", r"\bcpp\b|c[oó]digo\s+procesal\s+penal\b"),
    ("CODIGO_PROCESAL_CIVIL", r"\bcpc\b|c[oó]digo\s+procesal\s+civil\b"),
    ("CODIGO_PENAL", r"c[oó]digo\s+penal\b"),
    ("CODIGO_CIVIL", r"c[oó]digo\s+civil\b"),
    ("CODIGO_TRABAJO", r"c[oó]digo\s+(?:del?\s+)?trabajo\b"),
    ("CODIGO_FAMILIA", r"c[oó]digo\s+de\s+familia\b"),
    ("CODIGO_NOTARIADO", r"c[oó]digo\s+(?:del?\s+)?notariado\b"),
)
CONTAMINATED = r"\[(Cliente|Empresa)_An[oó]nimo|Tel[eé]fono_Oculto|Expediente_Anonimizado\]"
CORPUS_NAMED = r"seg[uú]n el corpus|de acuerdo (?:a|con) el corpus|corpus jur[ií]dico"
EVIDENCE_ASKED = r"\b(fuente|citas?|hash|texto recuperado|fragmento(?:s)?\s+(?:recuperado|del corpus))\b"
PROCEDURAL = (
    r"\b(plazo[s]?|t[eé]rmino[s]?|recurso de|interponer|apelaci[oó]n|casaci[oó]n|reposici[oó]n|queja|procedimiento|fase|etapa|audiencia"
    r"|d[ií]as h[aá]biles|notificaci[oó]n|vencimiento|prescripci[oó]n|caducidad|tramit[ae]|proceso|instancia|ejecutoria|calend[a]|c[oó]mputo)\b"
)
NORMATIVE = (
    r"\b(art[ií]culo\s+\d+|art\.\s*\d+|decreto\s+[\d-]+|cpc|cpp|c[oó]digo\s+(civil|procesal|penal)|texto\s+del\s+art|qu[eé]\s+dice\s+el\s+art"
    r"|literal\s+del\s+art|norma|ley especial|reglamento)\b"
)
GREETING = r"^(hola|buenos\s|buenas\s|gracias|ok\b|bien\b|entendido|cl[aá]ro|ayuda|help|start|inicio|empez|comenz|\?+)\s*[.!]?\s*$"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
IDENTITY, PHONE = r"\b\d{13}\b", r"\b\d{4}-\d{4}\b"
TAX = r"\bRTN[:\s]*\d{14}\b"
CASE_FILE = r"\bExp(?:ediente)?\.?\s*[:\s]*\d{2,6}[-/]\d{2,6}\b"
PRIVATE = r"\b\d{4}-\d{4}\b|\bRTN\s*[:#]?\s*\d{14}\b|\bDNI\s*[:#]?\s*\d{13}\b"
STRUCTURED = ((IDENTITY, "[DNI]"), (PHONE, "[TELEFONO]"), (EMAIL, "[EMAIL]"), ("(?i)" + TAX, "[RTN]"), ("(?i)" + CASE_FILE, "[EXPEDIENTE]"))
QUESTION = ((IDENTITY, "[DNI]"), (PHONE, "[TEL]"), (EMAIL, "[EMAIL]"))
DATES = r"\b\d{1,2}\s+de\s+[a-záéíóú]+\s+de\s+\d{4}\b|\b\d{1,2}/\d{1,2}/\d{4}\b"

#: White space at the ends of a text that trimmed() takes off, with the no-break space.
BLANK = "\t\n\x0b\f\r \u00a0"

#: EMAIL, searched in time linear in the text: a match begins where a run of its characters does, or where the last match ended.
EMAIL_SEARCH = r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

#: Java's \b takes accented letters for word characters; the patterns mean ASCII words.
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def java(pattern: str) -> str:
    """pattern without regard to case, accented letters included, and with ASCII word boundaries at its ends."""
    return "(?iu)" + pattern.replace(r"\b(", BEFORE + "(").replace(r")\b", ")" + AFTER)


def found(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(java(pattern)), F.lit(False))


def first_match(text: Column, named) -> Column:
    """The name of the first pattern that text matches, or null."""
    return F.coalesce(*[F.when(found(text, p), F.lit(name)) for name, p in named])


def article_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, java(ARTICLE_NUMBER), 1), F.lit(""))


def contaminated(text: Column) -> Column:
    return F.coalesce(text.rlike(CONTAMINATED), F.lit(False))


def searched(pattern: str) -> str:
    """The form of a pattern that does not begin anew at every character of a long run."""
    return EMAIL_SEARCH if pattern == EMAIL else pattern


def replaced(text: Column, patterns) -> Column:
    now = text
    for pattern, mark in patterns:
        after = F.regexp_replace(now, searched(pattern), mark)
        # Addresses are looked for only where there is an at sign; no mark holds one.
        now = F.when(F.contains(text, F.lit("@")), after).otherwise(now) if pattern == EMAIL else after
    return now


def anonymised_question(text: Column) -> Column:
    return replaced(text, QUESTION)


def anonymised(text: Column) -> Column:
    return replaced(text, STRUCTURED)


def has_structured(text: Column) -> Column:
    """Whether anonymised() replaces anything; each pattern is tried on what the ones before have left."""
    any_found, now = F.lit(False), text
    for pattern, mark in STRUCTURED:
        any_found, now = any_found | now.rlike(searched(pattern)), F.regexp_replace(now, searched(pattern), mark)
    return F.coalesce(any_found, F.lit(False))


def has_residue(text: Column) -> Column:
    return F.coalesce(text.rlike(IDENTITY) | text.rlike("(?i)" + TAX) | text.rlike(EMAIL_SEARCH) | text.rlike(PHONE), F.lit(False))


def has_private_data(text: Column) -> Column:
    """Whether text holds a mark of CONTAMINATED or a match of PRIVATE, both tried only where a character can begin one."""
    marked, private = r"(?=[\[TE])(?:" + CONTAMINATED + ")", r"(?i)(?=[\drd])(?:" + PRIVATE + ")"
    return F.coalesce(text.rlike(marked) | text.rlike(private), F.lit(False))


def trimmed(text: Column) -> Column:
    """Without white space at the ends, line breaks and no-break spaces included."""
    return F.btrim(text, F.lit(BLANK))


def normalised(text: Column) -> Column:
    """Line ends, trailing blanks, runs of empty lines, page lines and outer white space, in this order."""
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    text = F.regexp_replace(text, r"(?<![ \t])[ \t]++\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return trimmed(F.regexp_replace(text, r"(?imu)^\s*P[aá]gina\s+\d+(\s+de\s+\d+)?\s*$", ""))


def redacted_email(email: Column) -> Column:
    """The first two characters and the domain."""
    return F.when(email.contains("@"), F.concat(F.substring(email, 1, 2), F.lit("***@"), F.substring_index(email, "@", -1))).otherwise(F.lit("***"))


def redacted_id(value: Column, keep: int = 4) -> Column:
    return F.when(value.isNull(), F.lit("(none)")).otherwise(F.concat(F.lit("***"), F.right(value, F.lit(keep))))


def sanitised_error(message: Column, length: int = 200) -> Column:
    return F.substring(F.regexp_replace(message, EMAIL_SEARCH, "[email]"), 1, length)


def sanitised_query(text: Column, length: int = 400) -> Column:
    return F.substring(trimmed(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")), 1, length)


def snippet(text: Column, length: int = 450) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, length)


def normal_url(url: Column) -> Column:
    """Lower-case host and path; a URL that cannot be parsed as a whole in lower case."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    return F.lower(F.coalesce(F.concat(host, path), url))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def fragment_hash(content: Column, number: Column, source: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", content, F.coalesce(number, F.lit("")), source), 256), 1, 8)


def user_hash(identifier: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(identifier, F.lit(salt)), 256), 1, 32)


def identity_key(email: Column) -> Column:
    return F.concat(F.lit("email:"), F.lower(F.trim(email)))


def legacy_identity(email: Column, payer: Column, sub_id: Column) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.concat(F.lit("email:"), some(email)), F.concat(F.lit("payer:"), some(payer)), F.concat(F.lit("sub:"), some(sub_id)))


def client_key(forwarded: Column, real: Column) -> Column:
    """ip: and the first hop, or unknown."""
    return F.concat(F.lit("ip:"), F.coalesce(F.nullif(F.trim(F.substring_index(F.coalesce(forwarded, real), ",", 1)), F.lit("")), F.lit("unknown")))


def route(text: Column, mode: Column) -> Column:
    """A procedural, B normative, C both, D none."""
    asked = trimmed(text)
    procedural, normative = found(asked, PROCEDURAL), found(asked, NORMATIVE)
    return (
        F.when(mode.isin("sala_ia", "sala_penal") | (F.length(asked) < 15) | found(asked, GREETING), "D")
        .when(procedural & normative, "C")
        .when(procedural, "A")
        .when(normative, "B")
        .when(mode.isin("analisis", "analisis_penal", "documento", "escritos_penales"), "C")
        .otherwise("A")
    )


def evidence_needed(text: Column, forced: Column) -> Column:
    return forced | found(text, CORPUS_NAMED) | found(text, EVIDENCE_ASKED) | article_number(text).isNotNull()


def plan_param(value: Column) -> Column:
    """The tier that a URL's parameter names, or null for anything but the paid tiers."""
    return F.when(value.isin("pro", "academico"), value)


def without_nul(text: Column) -> Column:
    return F.regexp_replace(text, r"\x00", "")


def bare_email(email: Column) -> Column:
    """The first two characters and what follows the first at sign; missing addresses are named so, others without one are hidden."""
    domain = F.get(F.split(email, "@"), F.lit(1))
    shown = F.concat(F.substring(F.substring_index(email, "@", 1), 1, 2), F.lit("***@"), domain)
    return F.when(F.coalesce(email, F.lit("")) == "", "(none)").when(F.coalesce(domain, F.lit("")) == "", "***").otherwise(shown)


def project_reference(url: Column, pattern: str = r"https://([a-z0-9]+)\.supabase\.co") -> Column:
    """The first five and last four characters of the project that a URL names, or no_url."""
    name = F.regexp_extract(url, pattern, 1)
    return F.when(F.coalesce(name, F.lit("")) == "", "no_url").otherwise(F.concat(F.substring(name, 1, 5), F.lit("…"), F.right(name, F.lit(4))))


def bare_error(message: Column, length: int = 80) -> Column:
    """A message without URLs and runs that look like tokens."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(message, F.lit("")), r"https?://\S+", "[url]"), "[A-Za-z0-9_-]{25,}", "[tok]"), 1, length)


UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def is_uuid4(value: Column) -> Column:
    return F.coalesce(value.rlike("(?i)" + UUID4), F.lit(False))


def reference_id(millis: Column, identifier: Column, prefix: str = "REF") -> Column:
    """prefix, the time in base 36 and eight digits of the identifier's hash."""
    return F.concat_ws("-", F.lit(prefix), F.upper(F.conv(millis.cast("string"), 10, 36)), F.upper(F.substring(F.sha2(identifier, 256), 1, 8)))


def first_key(values: Column, keys: tuple[str, ...], length: int = 200) -> Column:
    """The value of the first of keys that a map holds and that is not null, empty or None; cut, without NULs."""
    usable = lambda v: F.when(~v.isin("", "None"), without_nul(F.substring(v, 1, length)))
    return F.coalesce(*[usable(F.try_element_at(values, F.lit(k))) for k in keys])


def shortened(values: Column, length: int = 500) -> Column:
    """A map with each value cut, so that what is made of it stays well-formed."""
    return F.transform_values(values, lambda _, v: F.substring(v, 1, length))


def packed_id(plan: Column, user: Column, length: int = 100) -> Column:
    return F.to_json(F.struct(plan.alias("p"), F.substring(user, 1, length).alias("u")))


def teaser(content: Column, length: int) -> Column:
    return trimmed(F.substring(content, 1, length))


MORE = "… (continúa)"


def faq(question: Column, content: Column, length: int = 320, more: str = MORE) -> Column:
    """The structured data of a page that answers one question, as JSON."""
    answer = F.concat(teaser(content, length), F.when(F.length(content) > length, more).otherwise(""))
    entry = F.struct(F.lit("Question").alias("@type"), question.alias("name"), F.struct(F.lit("Answer").alias("@type"), answer.alias("text")).alias("acceptedAnswer"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), F.array(entry).alias("mainEntity")))


def model_for(route_column: Column, mode: Column, override: Column, allowed: tuple[str, ...], large: str, default: str) -> Column:
    """The override if it is on the list; else the large model for route C and the modes of analysis."""
    analysis = mode.isin("analisis", "analisis_penal", "documento", "escritos_penales")
    return F.when(override.isin(*allowed), override).when((route_column == "C") | analysis, large).otherwise(default)
