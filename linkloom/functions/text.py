"""Column functions over token arrays (ARRAY<STRING>) and texts. Nulls stay null; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]

# Words of code that carry no meaning of their own, with English and with Italian programmers.
CODE_STOP_WORDS = (
    "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for goto if implements import instanceof int interface long "
    "native new null package parameter private protected public return short static strictfp super switch synchronized this throws throw transient try void volatile while string integer "
    "get set exception array hash struct unsigned union"
).split()
ITALIAN_CODE_STOP_WORDS = (
    "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for goto if implements import instanceof int interface long "
    "native new null package parameter private protected public return short static strictfp super switch synchronized this throws throw transient try void exception volatile while string "
    "integer ottenere settare eccezione array hash struct unsigned union"
).split()
#: Frequent function words, own short lists; other lists are passed to stop_words().
ENGLISH_STOP_WORDS = ["a", "about", "after", "all", "an", "and", "any", "are", "as", "at", "be", "been", "before", "but", "by", "can", "could", "do", "does", "for", "from", "had", "has", "have", "he", "her", "his", "how", "i", "if", "in", "into", "is", "it", "its", "me", "more", "most", "my", "no", "not", "of", "on", "or", "our", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "was", "we", "were", "what", "when", "which", "while", "who", "why", "will", "with", "would", "you", "your"]
ITALIAN_STOP_WORDS = ["a", "ad", "agli", "ai", "al", "alla", "alle", "allo", "anche", "che", "chi", "ci", "come", "con", "cui", "da", "dagli", "dai", "dal", "dalla", "dalle", "degli", "dei", "del", "della", "delle", "dello", "di", "e", "ed", "gli", "ha", "hanno", "i", "il", "in", "io", "la", "le", "lo", "ma", "ne", "negli", "nei", "nel", "nella", "nelle", "non", "o", "per", "più", "quale", "quando", "quella", "quello", "questa", "questo", "se", "si", "sono", "su", "sua", "sugli", "sui", "sul", "sulla", "sulle", "suo", "tra", "tutti", "tutto", "un", "una", "uno"]
URL = r"https?://\S+|www\.\S+"


def each(f: Step) -> Step:
    """A step that maps every token."""
    return lambda t: F.transform(t, f)


def split_each(pattern: str) -> Step:
    """A step that splits every token; empty parts are kept."""
    return lambda t: F.flatten(F.transform(t, lambda x: F.split(x, pattern, -1)))


def keep(predicate: Step) -> Step:
    """TokenFilter: keeps the tokens that satisfy a predicate."""
    return lambda t: F.filter(t, predicate)


def camel_case(t: Column) -> Column:
    """getUserName -> get, User, Name; HTTPServerError -> HTTP, Server, Error."""
    spaced = lambda x: F.regexp_replace(F.regexp_replace(x, "([A-Z]+)", " $1"), "([A-Z][a-z]+)", " $1")
    return drop_empty(F.flatten(F.transform(t, lambda x: F.split(spaced(x), r"\s+", -1))))


separate = split_each("[/._]")
lower_case = each(F.lower)
letters_only = each(lambda x: F.regexp_replace(x, "[^a-zA-Z -]", ""))
no_urls = each(lambda x: F.regexp_replace(x, URL, ""))
one_space = each(lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
full_stop = each(lambda x: F.when(x.rlike(r"[.!;?]\z") | (x == ""), x).otherwise(F.concat(x, F.lit("."))))
no_last_mark = each(lambda x: F.regexp_replace(x, r"[.!;?]\z", ""))
drop_empty = keep(lambda x: x != "")
left_trimmed = each(lambda x: F.regexp_replace(x, r"^\s+", ""))


def stop_words(words: Sequence[str]) -> Step:
    """Removes words of a list; repeated tokens stay, unlike with array_except."""
    return lambda t: F.filter(t, lambda x: ~x.isin(list(words)))


def longer_than(n: int) -> Step:
    return keep(lambda x: F.length(x) > n)


# Endings that a noun may lose, and what stands in their place.
NOUN_ENDINGS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))


def base_forms(word: Column) -> Column:
    """The word and what it becomes by each ending it has; those in a lexicon are its possible lemmas."""
    forms = [F.when(word.endswith(old), F.concat(F.substring(word, F.lit(1), F.length(word) - len(old)), F.lit(new))) for old, new in NOUN_ENDINGS]
    return F.array_compact(F.array(word, *forms))


def lemmas(table: Column) -> Step:
    """Replaces tokens by their lemma in a MAP<STRING, STRING>; unknown ones stay."""
    return each(lambda x: F.coalesce(F.try_element_at(table, x), x))


def javadoc_filter(t: Column) -> Column:
    """Drops tokens of @throws, @author and @version, takes out the tags @param, @return and @link, splits again."""
    kept = F.filter(t, lambda x: ~x.rlike("(?i)@(throws|author|version)"))
    return drop_empty(F.flatten(F.transform(kept, lambda x: F.split(F.regexp_replace(x, "(?i)@(param|return|link)", ""), r"\s+", -1))))


def pipeline(*steps: Step) -> Step:
    """The steps from left to right as one projection."""
    return lambda t: reduce(lambda x, f: f(x), steps, t)


#: The named chains of steps for requirements and code in English and Italian, and for sentences given to a model.
CHAINS: dict[str, Step] = {
    "req_en": pipeline(no_urls, separate, letters_only, camel_case, lower_case, stop_words(ENGLISH_STOP_WORDS), longer_than(2), drop_empty),
    "req_it": pipeline(no_urls, separate, letters_only, camel_case, lower_case, stop_words(ITALIAN_STOP_WORDS), longer_than(2), drop_empty),
    "code_en": pipeline(separate, letters_only, camel_case, stop_words(CODE_STOP_WORDS), lower_case, stop_words(ENGLISH_STOP_WORDS), longer_than(2), drop_empty),
    "code_it": pipeline(separate, letters_only, camel_case, stop_words(ITALIAN_CODE_STOP_WORDS), lower_case, stop_words(ITALIAN_STOP_WORDS), longer_than(2), drop_empty),
    "sentence": pipeline(no_urls, one_space, full_stop, drop_empty),
}


def word_tokens(text: Column, italian: bool = False) -> Column:
    """Runs of letters and digits of any script, and every other mark by itself; in Italian an apostrophe ends a token first."""
    if italian:
        text = F.regexp_replace(text, "'", "' ")
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}])"), 1)


def sentences(text: Column) -> Column:
    """Cut after a full stop, exclamation or question mark, white space and anything but a lower-case letter, so not after most abbreviations."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+([^\p{Ll}\s])", "$1\x01$2"), "\x01", -1), lambda x: x.rlike(r"[^\t\n\x0b\f\r\p{Z}]"))


def words_by_sentence(text: Column) -> Column:
    return F.transform(sentences(text), lambda s: word_tokens(s))


def javadoc_description(text: Column) -> Column:
    """The text before the first block tag, always as a text."""
    return F.regexp_replace(text, r"(?is)@(param|throws|author|version|return).*$", "")


def array_suffix(type_name: Column, dimensions: Column) -> Column:
    """The type with [] for each dimension."""
    return F.concat(type_name, F.repeat(F.lit("[]"), dimensions))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]", -1), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def with_extension(name: Column, ext: str) -> Column:
    return F.concat(stem(name), F.lit(f".{ext}"))


def clean_parameter(p: Column) -> Column:
    """A parameter type without package, generics and white space."""
    return F.regexp_replace(F.regexp_replace(p, r"<.*>|\s", ""), r"^.*\.", "")


def call_key(method: Column, params: Column, class_name: Column | None = None) -> Column:
    """method(p1,p2) or Class.method(p1,p2), the key of a call graph."""
    key = F.concat(method, F.lit("("), F.concat_ws(",", F.transform(params, clean_parameter)), F.lit(")"))
    return key if class_name is None else F.concat(class_name, F.lit("."), key)


def choose_words(parts: dict[str, Column], names: Sequence[str]) -> Column:
    """The words of the named parts of a record in a row; nested parts are flattened by the caller."""
    return F.concat(*(F.coalesce(parts[n], F.array().cast("array<string>")) for n in names))
