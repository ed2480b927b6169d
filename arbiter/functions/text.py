"""Tokenizers and text functions as column expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists (fixed values).
STOPWORDS = (
    "the a an is in it of to and or for on at by with from that this are be was has have had not but as if its via can could will would may should "
    "still been when which also into than up more their they we you he she do did so then any all"
).split()
STOP = "a an the is in of for to and or as be that this with it at by on are was from has have been which may not its were".split()
OVERRULING_VOCAB = [
    "overruled", "overrule", "overrules", "abrogated", "abrogate", "disapproved", "disapprove", "no longer controlling", "expressly overruled", "hereby overrule", "prior precedent is overruled", "overruling",
]
QUERY_VOCAB = ["good law", "controlling authority", "controlling precedent", "still good", "still binding", "still valid", "still controlling"]
COMMON_WORDS = ["IS", "FOR", "THE", "ARE", "HAS", "NOT", "CAN", "AND", "OR", "IN", "A", "I", "MY", "IT", "NO"]
SALTS = "hydrochloride hcl sulfate phosphate sodium acetate tartrate mesylate maleate fumarate chloride bromide citrate succinate".split()
# Patterns (fixed values).
ID_PATTERNS = [r"CVE-\d{4}-\d+", r"GHSA-[a-zA-Z0-9]{4}-[a-zA-Z0-9]{4}-[a-zA-Z0-9]{4}", r"CWE-\d+", r"CVSS[^\s]*\s*[\d.]+"]
FRAMING = [
    (r"\battacker[s]?\b", "the maintainers"),
    (r"\bexploit[s]?\b", "address"),
    (r"\bvulnerabilit[y|ies]+\b", "issue"),
    (r"\bmalicious\b", "resolved"),
    (r"\breveal[s]?\b", "disclose"),
    (r"\bexpos[es]+\b", "resolve"),
    (r"\bbypass[es]+\b", "handle"),
    (r"\binjection\b", "input handling"),
    (r"\bexecution of arbitrary code\b", "a code execution issue"),
    (r"\bunauthorized\b", "unintended"),
    (r"\bremote code execution\b", "a code execution issue"),
]
PATCHED_SIGNALS = [
    r"\bfixed\b", r"\bpatched\b", r"\bremediated\b", r"\baddressed\b", r"\bmitigated\b", r"\bupgrade\b", r"\bupdate\b", r"\brelease[sd]?\b", r"\bresolve[sd]?\b", r"version\s+\d", r"\bpatch\s+is\s+available\b", r"\bhas been (fixed|patched|resolved|addressed)\b",
]
UNPATCHED_SIGNALS = [
    "no patch", "not (yet )?patched", "unpatched", "not been patched", "no fix", "has not been fixed", "remains (un)?mitigated", "no (known |available )?fix", "currently (has no|without) (a )?patch", "patch (is )?not (yet )?available",
]
CVE = r"CVE-\d{4}-\d+"
STILL_AFFECTED = "Is (.+?) still affected"
CASE_CITATION = r"([A-Z][a-z]+(?:\s+v\.\s+[A-Z][a-z]+)?),\s+\d+ [A-Z]\.\S+ \d+"
EMPLOYEE, TICKER = r"EMP\d{3}-\w+", r"\b([A-Z]{2,5})\b"
ONE_LETTER_TICKER = r"\b(?:for|in|trade|their|'s)\s+([A-Z])\b"
US_REPORT, FEDERAL_REPORT = r"(\d+)\s+U\.S\.\s+(\d+)", r"\d+\s+F\.[23]d\s+\d+"
CITED_YEAR = r"\((\d{4})\)"
RELEASE_TAG = r"github\.com/([^/]+)/([^/]+)/releases/tag/"
VERSION = r"\b(\d+\.\d+(?:\.\d+)*(?:[._-]\w+)?)\b"
RELEASE_HEADER = "This release includes maintenance updates and stability improvements. Users are encouraged to upgrade to the latest version. We thank the community for responsible reporting. "


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _listed(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


# -- tokenizers: forms that mean the same in every engine --------------------------------------


def tokens_w(text) -> Column:
    """Lower-cased runs of letters, numbers and ``_``; null gives no tokens."""
    plain = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: t != "")


def tokens_a(text) -> Column:
    return F.filter(tokens_w(text), lambda t: t.rlike("^[a-z0-9]+$"))


def tokens_l2(text) -> Column:
    return F.filter(tokens_w(text), lambda t: t.rlike("^[a-z]{2,}$"))


def tokens_l2_stop(text) -> Column:
    """As ``tokens_l2`` without the stop list; repeats stay."""
    return F.filter(tokens_l2(text), lambda t: ~t.isin(STOP))


TOKENIZERS = {"w": tokens_w, "a": tokens_a, "l2": tokens_l2, "l2_stop": tokens_l2_stop}


def token_set(text) -> Column:
    return F.array_distinct(tokens_l2(text))


def content_words(text) -> Column:
    return F.array_except(tokens_l2(text), _listed(STOPWORDS))


def jaccard(a, b) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    a, b = _col(a), _col(b)
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


# -- rewriting -----------------------------------------------------------------------------------


def simulate_patch_text(disclosure, packages=None, version: str = "3.x") -> Column:
    """A release-note style text: identifiers, framing, package names and version phrases are replaced."""
    text = _col(disclosure)
    for pattern in ID_PATTERNS:
        text = F.regexp_replace(text, "(?i)" + pattern, "")
    for pattern, to in FRAMING:
        text = F.regexp_replace(text, "(?i)" + pattern, to)
    if packages is not None:
        longest_first = F.array_sort(F.filter(_col(packages), lambda p: F.length(p) > 2), lambda a, b: F.length(b) - F.length(a))
        text = F.aggregate(longest_first, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?i)\Q"), p, F.lit(r"\E")), F.lit("the component")))
    text = F.regexp_replace(text, r"(?i)\b(before|prior to|versions?)\s+[\d.x]+", "")
    return F.concat(F.lit(f"Release notes — {version}\n{RELEASE_HEADER}"), F.trim(F.regexp_replace(text, r"\s{2,}", " ")))


def normalize_name(name) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(name)), rf"\s+({'|'.join(SALTS)})$", ""), r"\s+", " "))


def clean_text(text) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_col(text), r"(?m)^\d+(\.\d+)?\s+[A-Z ]+\n", ""), r"\s+", " "))


def first_indication(text, drug_name) -> Column:
    t, name = clean_text(text), _col(drug_name)
    for pattern in ("INDICATIONS AND USAGE", r"^\d\s+INDICATION", "1 INDICATION"):
        t = F.trim(F.regexp_replace(t, "(?i)" + pattern, ""))
    rest = F.regexp_replace(F.trim(F.substring(t, F.length(name) + 1, F.length(t))), "^[,. ]+", "")
    t = F.when(F.upper(t).startswith(F.substring(F.upper(name), 1, 8)), rest).otherwise(t)
    return F.trim(F.substring(t, 1, 250))


def mask_names(text, names: list) -> Column:
    """Every variant of a name, in any case, as ``this drug``; 180 characters without a closing dot."""
    t = _col(text)
    for name in names:
        n = _col(name)
        t = F.when(F.coalesce(n, F.lit("")) == "", t).otherwise(F.regexp_replace(t, F.concat(F.lit(r"(?i)\Q"), n, F.lit(r"\E")), F.lit("this drug")))
    return F.regexp_replace(F.substring(t, 1, 180), "[. ]+$", "")


def slug(text, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "_"), 1, most)


def slug_trimmed(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def html_text(html) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_col(html), "<[^>]+>", " "), r"\s+", " "))


# -- extraction ----------------------------------------------------------------------------------


def us_citation(text) -> Column:
    """``NNN U.S. NNN`` as volume and page, empty if there is none."""
    c = _col(text)
    return F.struct(F.regexp_extract(c, US_REPORT, 1).alias("volume"), F.regexp_extract(c, US_REPORT, 2).alias("page"))


def citations(text) -> Column:
    """All reports cited: U.S. ones first, then federal ones."""
    c = _col(text)
    return F.concat(F.regexp_extract_all(c, F.lit(US_REPORT), F.lit(0)), F.regexp_extract_all(c, F.lit(FEDERAL_REPORT), F.lit(0)))


def split_case_citation(text) -> Column:
    """Case name before, and citation of, a ``Name NNN U.S. NNN (YYYY)`` cell."""
    c = _col(text)
    cite = F.regexp_extract(c, r"(\d+)\s+U\.S\.?\s+(\d+)(?:\s*\(\s*\d{4}\s*\))?", 0)
    name = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(c, r"(?s)^(.*?)\d+\s+U\.S\.?\s+\d+", 1), r"\s+$", "")), r"[,\s]+$", "")
    return F.struct(F.when(cite == "", F.trim(c)).otherwise(name).alias("case_name"), F.regexp_replace(F.trim(cite), r"U\.S\.?\s+", "U.S. ").alias("citation"))


def citation_year(text, default: str = "2010") -> Column:
    found = F.regexp_extract(_col(text), CITED_YEAR, 1)
    return F.when(found == "", F.lit(default)).otherwise(found)


def release_url(references) -> Column:
    """The first URL of a release tag among an array of URLs."""
    return F.try_element_at(F.filter(_col(references), lambda u: u.rlike(RELEASE_TAG + r"[^/\s]+")), F.lit(1))


def parse_release_url(url) -> Column:
    c, pattern = _col(url), RELEASE_TAG + "(.+)$"
    return F.struct(F.regexp_extract(c, pattern, 1).alias("owner"), F.regexp_extract(c, pattern, 2).alias("repo"), F.regexp_replace(F.regexp_extract(c, pattern, 3), r"[?#].*$", "").alias("tag"))


def product_name(package, source, references, ident) -> Column:
    """The first that is there: package, repository of the source, repository of the release, the id."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.coalesce(some(_col(package)), some(F.regexp_extract(_col(source), r"github\.com/[^/]+/([^/\s]+)", 1)), some(parse_release_url(release_url(references))["repo"]), some(_col(ident)), F.lit("unknown"))


def cve_id(text) -> Column:
    return F.upper(F.regexp_extract(_col(text), "(?i)" + CVE, 0))


def security_entities(text) -> Column:
    return F.struct(cve_id(text).alias("cve_id"), F.trim(F.regexp_extract(_col(text), "(?i)" + STILL_AFFECTED, 1)).alias("product"))


def legal_entities(text) -> Column:
    cite = F.regexp_extract(_col(text), "(?i)" + CASE_CITATION, 0)
    return F.struct(F.when(cite != "", slug(cite)).alias("case_slug"))


def finance_entities(text) -> Column:
    c = _col(text)
    return F.struct(F.upper(F.regexp_extract(c, "(?i)" + EMPLOYEE, 0)).alias("employee_id"), F.upper(F.regexp_extract(c, TICKER, 1)).alias("security_ticker"))


def query_entities(text) -> Column:
    """Employee and ticker of a question; null where there is none."""
    c = _col(text)
    emp = F.try_element_at(F.regexp_extract_all(c, F.lit(rf"\b{EMPLOYEE}\b"), F.lit(0)), F.lit(1))
    capitals = F.filter(F.regexp_extract_all(c, F.lit(TICKER), F.lit(1)), lambda w: ~w.isin(COMMON_WORDS))
    single = F.regexp_extract(c, ONE_LETTER_TICKER, 1)
    return F.struct(emp.alias("employee"), F.coalesce(F.try_element_at(capitals, F.lit(1)), F.when(single != "", single)).alias("ticker"))


def strip_cves(text) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(text), "(?i)" + CVE, ""), r"^[ ,.]+|[ ,.]+$", "")


def version_set(text) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(text), F.lit(VERSION), F.lit(1))))


def fixed_versions(affected) -> Column:
    """Distinct non-empty ``fixed`` versions of ``affected[].ranges[].events[]``."""
    ranges = F.flatten(F.transform(_col(affected), lambda a: a["ranges"]))
    events = F.flatten(F.transform(ranges, lambda r: r["events"]))
    return F.array_distinct(F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: v.isNotNull() & (v != "")))


def first_english(descriptions) -> Column:
    return F.try_element_at(F.filter(_col(descriptions), lambda d: d["lang"] == "en"), F.lit(1))["value"]


def cpe_product(criteria) -> Column:
    """The product of the first CPE string that names one."""
    names = F.transform(_col(criteria), lambda c: F.replace(F.try_element_at(F.split(c, ":"), F.lit(5)), F.lit("_"), F.lit(" ")))
    return F.try_element_at(F.filter(names, lambda n: n.isNotNull() & (n != "") & (n != "*")), F.lit(1))


# -- predicates and reports ------------------------------------------------------------------------


def is_english(text) -> Column:
    """Whether over 0.8 of the characters are ASCII; false for empty texts and null."""
    c = _col(text)
    return F.coalesce((F.length(c) > 0) & (F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / F.length(c) > 0.8), F.lit(False))


def any_phrase(text, phrases: list[str]) -> Column:
    low, out = F.lower(_col(text)), F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def phrases_found(text, phrases: list[str]) -> Column:
    low = F.lower(_col(text))
    return F.filter(_listed(sorted(phrases)), lambda p: low.contains(p))


def check_vocab(text) -> Column:
    return F.struct(
        any_phrase(text, OVERRULING_VOCAB).alias("has_overruling_vocab"), any_phrase(text, QUERY_VOCAB).alias("has_query_vocab"), phrases_found(text, OVERRULING_VOCAB).alias("overruling_words_found"), phrases_found(text, QUERY_VOCAB).alias("query_words_found")
    )


def evaluate_answer(response, gold) -> Column:
    low = F.lower(_col(response))
    patched, unpatched = low.rlike("|".join(PATCHED_SIGNALS)), low.rlike("|".join(UNPATCHED_SIGNALS))
    overlap = F.arrays_overlap(version_set(response), version_set(gold))
    return F.struct(
        (patched & ~unpatched & overlap).alias("correct"), (unpatched & ~patched).alias("confident_wrong"), patched.alias("is_patched_claim"), unpatched.alias("is_unpatched_claim"), overlap.alias("version_overlap"), version_set(response).alias("resp_versions"), version_set(gold).alias("gold_versions")
    )


def query_variants(product, cve, freeform, ident) -> Column:
    """The five styles of one question; the swapped letters are chosen by the digest of the id."""
    p, c = _col(product), _col(cve)
    free = F.coalesce(_col(freeform), F.concat(F.lit("Is "), p, F.lit(" still vulnerable to "), c, F.lit("?")))
    number = F.conv(F.substring(F.md5(_col(ident).cast("string")), 1, 7), 16, 10).cast("long")
    at = F.pmod(number, F.greatest(F.length(p) - 1, F.lit(1))).cast("int") + 1
    swapped = F.concat(F.substring(p, F.lit(1), at - 1), F.substring(p, at + 1, F.lit(1)), F.substring(p, at, F.lit(1)), F.substring(p, at + 2, F.length(p)))
    noisy = F.when(F.length(p) < 3, p).otherwise(swapped)
    suffix = F.element_at(F.split(c, "-"), -1)
    suffix = F.when(F.length(suffix) > 5, F.substring(suffix, -5, 5)).otherwise(suffix)
    return F.struct(
        F.concat(F.lit("Is "), p, F.lit(" affected by "), c, F.lit("?")).alias("structured"),
        free.alias("freeform"),
        F.regexp_replace(free, F.concat(F.lit(r"(?i)\Q"), p, F.lit(r"\E")), F.lit("[PRODUCT]")).alias("entity_omit"),
        F.concat(F.lit("Is "), noisy, F.lit(" affected by "), c, F.lit("?")).alias("noisy"),
        F.concat(F.lit("Any fix available for vulnerability "), suffix, F.lit("?")).alias("partial_ent"),
    )


def fill_template(template, **slots) -> Column:
    """``{name}`` slots of a template column; null values as ``N/A``, timestamps as ``Month DD, YYYY``."""
    t = _col(template)
    for name, value in slots.items():
        t = F.replace(t, F.lit("{" + name + "}"), F.coalesce(_col(value), F.lit("N/A")))
    return t


def long_date(ts) -> Column:
    return F.date_format(_col(ts), "MMMM dd, yyyy")


def prompt(question, docs, most: int = 1200) -> Column:
    """A prompt of numbered documents, each cut at ``most`` characters, then the question."""
    numbered = F.transform(_col(docs), lambda d, i: F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit("]\n"), F.substring(d, 1, most)))
    return F.concat(F.array_join(numbered, "\n\n---\n\n"), F.lit("\n\nQuestion: "), _col(question))
