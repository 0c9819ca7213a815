"""Column functions over identifiers and texts, and tables of search terms built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no search term.
STOP_WORDS = ("a", "an", "and", "are", "before", "code", "does", "for", "from", "how", "in", "is", "it", "of", "or", "repository", "the", "to", "what", "where", "which", "with")


def normalized_identifier(col: Column) -> Column:
    """Words of an identifier: split where case or digits turn, other characters to blanks, lower case."""
    split = F.regexp_replace(F.regexp_replace(col, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(split, r"[^\p{L}\p{N}]+", " ")))


def search_text(*cols: Column) -> Column:
    """Each value and its words, without blanks and repeats, one to a line."""
    values = F.array(*[x for c in cols for x in (c, normalized_identifier(c))])
    return F.array_join(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (F.trim(x) != ""))), "\n")


def grams(*cols: Column, most: int = 3) -> Column:
    """All distinct substrings of 1 to ``most`` characters of the values in lower case."""
    def of(low: Column, n: int) -> Column:
        count = F.length(low) - n + 1
        places = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
        return F.when(count > 0, F.transform(places, lambda i: low.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    parts = [of(F.lower(F.coalesce(col, F.lit(""))), n) for col in cols for n in range(1, most + 1)]
    return F.array_distinct(F.concat(*parts))


def terms(col: Column) -> Column:
    """The set of a question's words and their singular forms, without stop words, sorted."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.regexp_replace(col, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+", " "), " "), lambda x: x != "")

    def one(x: Column) -> Column:
        ies = F.concat(F.substring(x, F.lit(1), F.length(x) - 3), F.lit("y"))
        s = F.substring(x, F.lit(1), F.length(x) - 1)
        return F.when((F.length(x) > 4) & x.endswith("ies"), ies).when((F.length(x) > 3) & x.endswith("s") & ~x.endswith("ss"), s).otherwise(x)

    both = F.concat(words, F.transform(words, one))
    return F.array_sort(F.array_except(F.array_distinct(both), F.array(*[F.lit(w) for w in STOP_WORDS])))


def typo_limit(length: Column) -> Column:
    """How many edits a suggestion may be away."""
    return F.greatest(F.lit(2), F.least(F.lit(5), F.floor((length + 1) / 3)))


def estimate_tokens(chars: Column) -> Column:
    return F.ceil(chars / 4)


def namespace_name(col: Column) -> Column:
    """What stands before the slash; null without one."""
    return F.when(F.instr(col, "/") > 0, F.substring_index(col, "/", 1))


def byte_bucket(n: Column) -> Column:
    return F.when(n < 2048, "small").when(n < 8192, "medium").otherwise("large")


def backoff(base: int, most: int, attempts: Column, shift: int = 20) -> Column:
    """base doubled for each attempt, at most ``most``."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), F.least(attempts, F.lit(shift)))).cast("long")


# Segments of a path, and forms of a file name, that tell a source's role.
TEST_SEGMENTS = ("test", "tests", "spec", "specs", "__tests__")
GENERATED_SEGMENTS = ("generated", "gen", "autogen", "autogenerated")
VENDOR_SEGMENTS = ("vendor", "vendors", "third_party", "third-party", "node_modules")
TEST_FILE = r"(?i)(?:^|/)(?:test|spec)[_-][^/]+\.[^/]+$|(?:^|/)[^/]+(?:[_-](?:test|spec)|\.(?:test|spec))\.[^/]+$"


def source_role(path: Column) -> Column:
    """vendor, generated, test, production, or unknown where there is no path, from its segments and file name in lower case."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    seg = F.split(p, "/")

    def any_of(*names: str) -> Column:
        return F.arrays_overlap(seg, F.array(*[F.lit(x) for x in names]))

    return (
        F.when(path.isNull() | (path == ""), "unknown")
        .when(any_of(*VENDOR_SEGMENTS), "vendor")
        .when(any_of(*GENERATED_SEGMENTS), "generated")
        .when(any_of(*TEST_SEGMENTS) | p.rlike(TEST_FILE), "test")
        .otherwise("production")
    )


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a segment."""
    import re

    out, i = [], 0
    while i < len(glob):
        for token, made in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(token, i):
                out.append(made)
                i += len(token)
                break
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


def normalized_path(path: Column) -> Column:
    """``.`` and ``..`` folded away."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    fold = F.aggregate(parts, empty, lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(fold, "/")


# Questions that ask for a set of things, or for a course of events.
ASKS_SET = (
    r"(?i)\b(?:all|list|which|what)\b.*\b(?:apis|classes|components|endpoints|files|functions|handlers|implementations|modules|namespaces|routes|symbols|tests)\b"
    r"|\b(?:modules|namespaces|components)\s+(?:expose|implement|provide)\b"
)
ASKS_FLOW = r"(?i)\b(?:before|after|flow|pipeline|responsible for|end[- ]to[- ]end|how.+(?:handled|processed|validated|sent|delivered|enforced))\b"


def query_shape(question: Column) -> Column:
    """lookup, set or flow by the words of a question; set comes first."""
    return F.when(question.rlike(ASKS_SET), "set").when(question.rlike(ASKS_FLOW), "flow").otherwise("lookup")


K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, length): words of letters and digits in lower case, counted per row."""
    words = docs.select(F.col(id_col).alias("id"), F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("words"))
    return words.select("id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("id", "term", "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, id_col: str, text_col: str, words: list[str]) -> DataFrame:
    """(id, score) of rows with at least one of the words; k1 1.2, b 0.75, idf ln(1 + (N - df + 0.5)/(df + 0.5)).

    Only postings of the words leave the scan. The number of rows and their mean length are one row.
    """
    wanted = sorted(set(words))
    split = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    base = docs.select(F.col(id_col).alias("id"), split.alias("words"))
    size = base.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    hits = base.select("id", F.size("words").alias("length"), F.explode(F.filter("words", lambda x: x.isin(*wanted))).alias("term")).groupBy("id", "term", "length").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as there are query words
    scored = hits.join(F.broadcast(df), "term")
    idf = F.log(1 + (F.lit(size.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(size.mean or 1.0)))
    return scored.groupBy("id").agg(F.sum(part).alias("score"))
