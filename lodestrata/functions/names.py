"""Name similarity as Column expressions: no Python runs on the rows.

Tokens are arrays of distinct lower-case strings.  Every function takes and returns Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TABLE_STOP_TOKENS = ("hst", "all", "inc", "npdid", "ncs", "totalt", "poly", "petreg", "id")
ROLE_STOP_TOKENS = ("fk", "id", "uri", "to", "by", "of", "has", "is", "the", "a", "an", "inv")
BOOLEAN_STOP_TOKENS = ("is", "has", "flag", "status", "type")
DISCRIMINATOR_NAMES = ("type", "kind", "category", "status", "flag", "discriminator")
DISCRIMINATOR_SUFFIXES = ("type", "kind", "level", "typemain", "typepart", "typeen", "typeno")
AMBIGUOUS_COLUMNS = ("type", "status", "kind", "category", "flag", "code", "level")
TRUE_WORDS = ("1", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "f", "false", "n", "no")


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _filled(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: t != ""))


def normalize(name: Column) -> Column:
    """Lower case without blanks, underscores and hyphens."""
    return F.lower(F.regexp_replace(name, r"[_\-\s]+", ""))


def tokenize(name: Column) -> Column:
    """Split at blanks, ``_``, ``-`` and before capitals; a part in capitals only stays whole."""

    def words(part: Column) -> Column:
        capitals = (F.length(part) > 1) & (part == F.upper(part)) & (part != F.lower(part))
        return F.when(capitals, F.array(part)).otherwise(F.split(F.regexp_replace(part, "([A-Z])", " $1"), r"\s+"))

    return _filled(F.transform(F.flatten(F.transform(F.split(name, r"[_\-\s]+"), words)), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def char_overlap(a: Column, b: Column) -> Column:
    """Common characters, counted with their multiplicity, over the longer length."""
    x, y = normalize(a), normalize(b)
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.split(x, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(x, c), times(y, c))))
    return F.when((F.length(x) > 0) & (F.length(y) > 0), common / F.greatest(F.length(x), F.length(y))).otherwise(F.lit(0.0))


def name_overlap(a: Column, b: Column) -> Column:
    """The larger of character overlap and token similarity."""
    return F.greatest(char_overlap(a, b), jaccard(tokenize(a), tokenize(b)))


def explain_similarity(a: Column, b: Column) -> Column:
    """A struct with what ``name_overlap`` is made of, rounded to four places."""
    chars, tokens = char_overlap(a, b), jaccard(tokenize(a), tokenize(b))
    return F.struct(
        a.alias("a"),
        b.alias("b"),
        F.array_sort(tokenize(a)).alias("tokens_a"),
        F.array_sort(tokenize(b)).alias("tokens_b"),
        F.round(chars, 4).alias("char_overlap"),
        F.round(tokens, 4).alias("token_jaccard"),
        F.round(F.greatest(chars, tokens), 4).alias("score"),
    )


def camel_tokens(name: Column) -> Column:
    """Tokens of two characters or more, split at case changes and at what isn't a letter or digit."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: F.length(t) >= 2))


def table_tokens(name: Column) -> Column:
    """As ``camel_tokens``, but the name is lower-cased first, and stop tokens go."""
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*TABLE_STOP_TOKENS)))


def token_coverage(table: Column, class_name: Column) -> Column:
    """Share of the table's tokens that a token of the class equals, or (both of four characters or more) begins or extends."""
    mine, theirs = table_tokens(table), camel_tokens(class_name)
    hit = lambda t: F.exists(theirs, lambda c: (t == c) | ((F.length(t) >= 4) & (F.length(c) >= 4) & (F.startswith(t, c) | F.startswith(c, t))))
    return F.when((F.size(mine) > 0) & (F.size(theirs) > 0), F.size(F.filter(mine, hit)) / F.size(mine)).otherwise(F.lit(0.0))


def alphanumeric(name: Column) -> Column:
    """Letters a-z and digits only, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def singular_lookup(name: Column) -> Column:
    """Lower case, ``_`` for hyphens and runs of blanks, without a plural ending."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "-", "_"), r"[_\s]+", "_")
    return F.when(base.endswith("ies"), F.regexp_replace(base, "ies$", "y")).when(base.endswith("s") & ~base.endswith("ss"), F.regexp_replace(base, "s$", "")).otherwise(base)


def local_name(uri: Column) -> Column:
    """What follows ``#``, or else the last part of the path."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(F.regexp_replace(uri, "/+$", ""), "/", -1))


def role_tokens(name: Column) -> Column:
    """Camel-split tokens of two characters or more that aren't role stop words."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.lower), lambda t: (F.length(t) > 1) & ~t.isin(*ROLE_STOP_TOKENS)))


def semantic_tokens(name: Column) -> Column:
    """Camel-split tokens, and beside each of four characters or more that ends in s the one without it."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    tokens = F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != "")
    short = F.transform(F.filter(tokens, lambda t: (F.length(t) > 3) & t.endswith("s")), lambda t: F.substring(t, F.lit(1), F.length(t) - 1))
    return F.array_distinct(F.concat(tokens, short))


def truth(value: Column) -> Column:
    """true, false, or null if the text is neither."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin(*TRUE_WORDS), F.lit(True)).when(v.isin(*FALSE_WORDS), F.lit(False))


def is_discriminator(column: Column) -> Column:
    bare = F.replace(F.lower(column), F.lit("_"), F.lit(""))
    return F.coalesce(bare.isin(*DISCRIMINATOR_NAMES) | bare.rlike(f"({'|'.join(DISCRIMINATOR_SUFFIXES)})$"), F.lit(False))


def ordered_tokens(name: Column) -> Column:
    """All tokens in their order, repeats included."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2")
    return F.transform(F.filter(F.split(spaced, "[^A-Za-z0-9]+"), lambda t: t != ""), F.lower)


def property_core(name: Column) -> Column:
    """Ordered tokens without a leading ``has``, ``has a``, ``has an`` or ``has the``."""
    t = ordered_tokens(name)
    bare = F.slice(t, 2, 1000)
    unwrapped = F.when(bare[0].isin("a", "an", "the"), F.slice(bare, 2, 1000)).otherwise(bare)
    return F.when(F.get(t, F.lit(0)) == "has", F.when(F.size(bare) > 0, unwrapped).otherwise(bare)).otherwise(t)


def identity_score(column: Column, property_name: Column, class_name: Column) -> Column:
    """1.0 if the property names the column, 0.98 if it names class and column together, else 0."""
    c, p, k = ordered_tokens(column), F.transform(property_core(property_name), lambda x: x), ordered_tokens(class_name)
    nothing = (F.size(c) == 0) | (F.size(p) == 0)
    qualified = (F.size(k) > 0) & ((p == F.concat(k, c)) | (p == F.concat(c, k)))
    return F.when(nothing, F.lit(0.0)).when(p == c, F.lit(1.0)).when(qualified, F.lit(0.98)).otherwise(F.lit(0.0))


def strip_wrapper(name: Column) -> Column:
    """A property's name without ``has_``, ``has_a_``, ``has_an_``, ``has_the_``, or ``has`` before a capital."""
    return F.regexp_replace(name, r"^(?:has_(?:(?:an|a|the)_)?|has(?:An|A|The)?(?=[A-Z]))", "")


def names_directly(column: Column, property_name: Column) -> Column:
    """Whether the property's unwrapped name is the column's, but for case and separators."""
    return (alphanumeric(strip_wrapper(property_name)) == alphanumeric(column)) | (alphanumeric(property_name) == alphanumeric(column))


def value_class_score(value: Column, class_name: Column) -> Column:
    """How well a stored value names a class: equality, acronym or prefix, containment, shared tokens; else 0."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    v, c = alphanumeric(text), alphanumeric(class_name)
    compact = F.regexp_replace(text, "[^A-Za-z0-9]+", "")
    capital = (compact == F.upper(compact)) & compact.rlike("[A-Za-z]")
    marked = (F.length(compact) == 2) & compact.rlike("^[A-Z]{2}$") & text.rlike(r"[^A-Za-z0-9\s]")
    silent = ((F.length(v) < 3) & ~marked) | ~v.rlike("[a-z]") | v.isin("true", "false", "yes", "no") | (c == "")
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(class_name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"), "[^A-Za-z0-9]+"), lambda p: p != "")
    initials = F.lower(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), ""))
    short = (F.length(compact).between(3, 8) | marked) & capital & (F.startswith(c, v) | (v == initials))
    share = F.length(v) / F.length(c)
    tokens = jaccard(semantic_tokens(text), semantic_tokens(class_name))
    return (
        F.when(silent, F.lit(0.0))
        .when(v == c, F.lit(1.0))
        .when(short, F.lit(0.94))
        .when(F.contains(c, v) & (F.length(v) >= 5) & (share >= 0.35), F.least(F.lit(0.98), F.lit(0.72) + F.lit(0.26) * share))
        .when(tokens >= 0.75, tokens)
        .otherwise(F.lit(0.0))
    )
