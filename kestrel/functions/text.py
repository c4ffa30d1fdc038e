"""Scalar text functions as JVM-side Column expressions (F1-F16).

Everything here stays inside Catalyst / whole-stage codegen: regexes run in
the JVM, arrays use higher-order functions.  No Python per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the reference behaviour / public defaults)
# ---------------------------------------------------------------------------

# Python's str.isspace() set, i.e. what Python's Unicode-aware `\s` matches.
# Written as explicit code points so Java regex and RE2 (the SQL oracle) agree.
WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# Generic words never used for query expansion (fixed values).  Note that
# "decent, like" is one string, so neither "decent" nor the pair is split.
GENERIC_BLACKLIST = [
    "great", "good", "bad", "friendly", "best", "excellent", "amazing", "awesome", "terrible",
    "nice", "wonderful", "fantastic", "bully", "horrible", "awful", "decent, like", "franklin",
    "place", "spot", "location", "area", "service", "staff", "experience",
    "time", "times", "visit", "definitely", "highly", "really", "always",
    "food", "drinks", "drink", "menu", "order", "ordered",
    "recommend", "lot", "recommended", "love", "just", "loved", "favorite", "like", "best", "worst",
    "got", "get", "went", "go", "come", "came", "back", "try", "tried",
]

# English stop words: Spark ML's public default list
# (StopWordsRemover.loadDefaultStopWords("english")), 181 words, fixed values.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these those
am is are was were be been being have has had having do does did doing a an the and but if or because
as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any
both each few more most other some such no nor not only own same so than too very s t can will just
don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's
she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't
don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's
let's ought that's there's what's when's where's who's why's would
""".split()

# Noun detachment rules (suffix -> replacement) of the public WordNet morphology,
# in their published order.  Fixed values.
LEMMA_RULES = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]

# ---------------------------------------------------------------------------
# Column expressions
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def parse_categories(c) -> Column:
    """comma list -> trimmed items; null or '' -> []. Empty items are kept."""
    c = _c(c)
    items = F.transform(F.split(c, ","), lambda x: strip_ws(x))
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(items)


def clean_text(c) -> Column:
    """collapse every whitespace run to one space, strip; null -> ''."""
    collapsed = F.regexp_replace(_c(c), f"{WS_CLASS}+", " ")
    return F.coalesce(F.regexp_replace(collapsed, "^ | $", ""), F.lit(""))


def normalize_text(c) -> Column:
    """F2 then lower case."""
    return F.lower(clean_text(c))


def text_length(c) -> Column:
    """length in code points."""
    return F.length(_c(c))


def first_or_null(c) -> Column:
    """first element, null for an empty or null array."""
    return F.get(_c(c), 0)


def size_or_zero(c) -> Column:
    """array size, 0 for null."""
    return F.coalesce(F.size(_c(c)), F.lit(0)).cast("int")


def prefix_name(name, text) -> Column:
    """``"{name}. {text}"``; a null name becomes ''."""
    return F.concat(F.coalesce(_c(name), F.lit("")), F.lit(". "), _c(text))


def truncate(c, n: int) -> Column:
    """first n characters."""
    return F.substring(_c(c), 1, n)


_W = WS_CLASS[1:-1]
# Fixed values, the public Treebank word rules: these marks are tokens of their own, so are dots in a
# row, double dashes, and a comma or colon unless a digit follows; joined words come apart.
SPLIT_MARKS = r"[;@#$%&?!*\[\](){}<>\"`\x{AB}\x{BB}\x{2018}\x{2019}\x{201C}-\x{201E}]|\.{2,}|--|[,:](?![0-9])"
JOINED_WORDS = r"\b(?:can(?=not\b)|gim(?=me\b)|lem(?=me\b)|gon(?=na\b)|wan(?=na\b)|got(?=ta\b))"
# What then stands between white space, without a contraction's end (n't, 's, 'll ...), outer apostrophes
# and a final dot, is a word if it is all letters: "don't" -> do, "bar/pub", "x2" and "42" -> nothing.
TOKEN_PATTERN = rf"(?:^|[{_W}])'*+(\p{{L}}+?)(?:n't|'(?:s|m|d|ll|re|ve))?'*+\.?(?=[{_W}]|$)"


# The same rules as ``tokens`` applies them: single marks and white space become spaces by ``translate``, the words of JOINED_WORDS
# are looked for before they are taken apart, and letters are read greedily (what may follow a word starts with no letter but the n of
# n't, so both ways find the same word).
SINGLE_MARKS = ";@#$%&?!*[](){}<>\"`\xab\xbb\u2018\u2019\u201c\u201d\u201e"
SPACES = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")
LONG_MARKS = r"\.{2,}|--|[,:](?![0-9])"
JOINED = ("cannot", "gimme", "lemme", "gonna", "wanna", "gotta")
SPACED_TOKEN = r"(?:^| )'*+(\p{L}+)(?:n't|'(?:s|m|d|ll|re|ve))?'*+\.?(?= |$)"


def tokens(c) -> Column:
    """lower, split into words by the Treebank rules, keep pure-letter words.

    Passes over the text instead of a split and a lambda per token.
    """
    gone = SINGLE_MARKS + SPACES
    apart = F.regexp_replace(F.translate(F.lower(_c(c)), gone, " " * len(gone)), LONG_MARKS, " ")

    def parted(text: Column) -> Column:
        some = reduce(lambda a, b: a | b, [text.contains(w) for w in JOINED])
        return F.when(some, F.regexp_replace(text, JOINED_WORDS, "$0 ")).otherwise(text)

    # the lambda has the text made once, however often it is asked for
    return F.regexp_extract_all(F.get(F.transform(F.array(apart), parted), 0), F.lit(SPACED_TOKEN), 1)


def valid_candidate(c) -> Column:
    """at least 3 characters and no digit."""
    c = _c(c)
    return (F.length(c) >= 3) & ~c.rlike(r"\d")


def query_terms(c) -> Column:
    """Lower-cased query split on single spaces (F14 uses this set)."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(c)), " "), lambda t: t != ""))


def append_word(query, word) -> Column:
    """F16: ``"{query} {word}"``, the query unchanged when the word is null or ''."""
    word = _c(word)
    return F.when(word.isNull() | (word == ""), _c(query)).otherwise(F.concat_ws(" ", _c(query), word))


def overlap_words(a, b) -> Column:
    """Shared lower-case whitespace words of two strings."""
    return F.array_intersect(F.split(F.lower(_c(a)), f"{WS_CLASS}+"),
                             F.split(F.lower(_c(b)), f"{WS_CLASS}+"))


# ---------------------------------------------------------------------------
# DataFrame-level text operators
# ---------------------------------------------------------------------------


def lemma_map(vocab: DataFrame, term_col: str = "term", lexicon: DataFrame | None = None) -> DataFrame:
    """noun lemma of each distinct term, as a (term, lemma) table.

    A rule fires only if its output is itself in the lexicon (default: the
    vocabulary); the shortest output wins, rule order breaks ties.  Only terms
    that change are returned, so callers left-join and ``coalesce``.  Works on
    distinct terms, never per row of text.
    """
    suffix_ok = F.lit(False)
    for suf in sorted({suf[-1] if suf != "men" else "men" for suf, _ in LEMMA_RULES}):
        suffix_ok = suffix_ok | F.col("term").endswith(suf)
    all_terms = vocab.select(F.col(term_col).alias("term"))
    terms = all_terms.where(suffix_ok).distinct()  # only terms a rule can change
    # a lexicon holds a term once (and a semi join does not mind if not): it is not aggregated again
    lex = lexicon.select(F.col(term_col).alias("cand")) if lexicon is not None else all_terms.select(F.col("term").alias("cand")).distinct()
    rules = F.array(*[
        F.struct(F.lit(i).alias("rule"),
                 F.when(F.col("term").endswith(suf) & (F.length("term") > len(suf)),
                        F.concat(F.expr(f"substring(term, 1, length(term) - {len(suf)})"), F.lit(rep)))
                 .alias("cand"))
        for i, (suf, rep) in enumerate(LEMMA_RULES)
    ])
    cands = (terms.select("term", F.explode(rules).alias("r"))
             .select("term", "r.rule", "r.cand")
             .where(F.col("cand").isNotNull() & (F.length("cand") < F.length("term"))))
    hits = cands.join(lex, "cand", "left_semi")
    best = (hits.groupBy("term")
            .agg(F.min(F.struct(F.length("cand").alias("n"), F.col("rule"), F.col("cand"))).alias("b")))
    return best.select("term", F.col("b.cand").alias("lemma"))


def map_category_to_base(cats: DataFrame, base_labels: list[str], cat_col: str = "category") -> DataFrame:
    """longest base label (as given) contained in the normalised category, first on ties;
    no match or no labels -> the normalised category."""
    norm = normalize_text(F.col(cat_col))
    labels = [F.lit(b) for b in base_labels]
    if not labels:
        return cats.withColumn("base_label", norm)
    arr = F.array(*[F.struct(F.length(lb).alias("n"), F.lit(-i).alias("p"), lb.alias("label"))
                    for i, lb in enumerate(labels)])
    matches = F.filter(arr, lambda s: F.instr(norm, s["label"]) > 0)
    best = F.array_max(matches)
    return cats.withColumn("base_label", F.when(F.size(matches) > 0, best["label"]).otherwise(norm))
