"""Text functions of the retrieval engine as column expressions: tokens, particles, n-grams, features, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Particles that may end a Korean word, words without visual meaning, translations and concepts.
PARTICLES = [
    "으로서", "으로써", "이라고", "라고서", "에서는", "에서도", "에게서", "에서", "에게", "한테", "께서", "부터", "까지", "보다", "처럼", "마다", "이라", "라고", "이나", "라도", "에는", "에도", "으로",
    "로서", "로써", "은", "는", "이", "가", "을", "를", "와", "과", "도", "만", "의", "에", "로", "랑", "께", "들",
]
STOPWORDS = [
    "이미지", "사진", "그림", "사진들", "리스트", "목록", "장면", "모습", "느낌", "찾아줘", "찾아", "찾기", "검색", "보여줘", "보여", "줘", "관련", "그리고", "또는", "좀", "것", "거", "등", "수",
    "그", "이런", "저런", "어떤", "해줘", "image", "images", "photo", "photos", "picture", "pictures", "pic", "pics", "scene", "scenes", "shot", "shots",
    "find", "show", "search", "list", "the", "a", "an", "of", "with", "in", "on", "at", "and", "or", "to", "please", "me", "that", "this", "some",
    "any", "is", "are", "it",
]
TRANSLATIONS = {
    "오토바이": ["motorcycle", "motorbike", "bike", "scooter"], "바이크": ["motorcycle", "bike"], "스쿠터": ["scooter", "motorcycle"],
    "밤": ["night", "nighttime", "dark"], "야간": ["night", "nighttime"], "밤중": ["night", "midnight"], "낮": ["day", "daytime"], "주간": ["day", "daytime"],
    "주차": ["parking", "parked"], "주차장": ["parking", "lot"], "불": ["fire", "flame"], "화재": ["fire", "blaze"], "연기": ["smoke"],
    "사람": ["person", "people", "pedestrian"], "사람들": ["people", "pedestrians", "crowd"], "보행자": ["pedestrian", "people"], "군중": ["crowd", "people"],
    "대로변": ["street", "roadside", "avenue"], "도로": ["road", "street"], "거리": ["street", "downtown"], "골목": ["alley", "street"],
    "자동차": ["car", "vehicle"], "차량": ["vehicle", "car"], "차": ["car", "vehicle"], "트럭": ["truck"], "버스": ["bus"], "자전거": ["bicycle", "bike"],
    "강아지": ["dog", "puppy"], "개": ["dog"], "고양이": ["cat"], "바다": ["sea", "ocean", "beach"], "해변": ["beach", "shore"], "건물": ["building"],
    "사고": ["accident", "crash"], "비": ["rain", "rainy"], "눈": ["snow", "snowy"], "안개": ["fog", "mist"], "신호등": ["traffic light", "signal"],
    "횡단보도": ["crosswalk", "crossing"], "공원": ["park"], "실내": ["indoor", "inside"], "실외": ["outdoor", "outside"], "야외": ["outdoor"],
}
CONCEPTS = {
    "fire": "fire", "불": "fire", "화재": "fire", "flame": "flames", "smoke": "smoke", "연기": "smoke", "motorcycle": "motorcycle", "motorbike": "motorcycle", "오토바이": "motorcycle",
    "bike": "two-wheeler", "scooter": "scooter", "night": "night", "밤": "night", "야간": "night", "dark": "dark", "day": "daytime", "낮": "daytime",
    "parking": "parking", "parked": "parking", "주차": "parking", "person": "person", "people": "person", "pedestrian": "pedestrian", "사람": "person", "보행자": "pedestrian", "crowd": "crowd",
    "street": "street", "road": "road", "거리": "street", "도로": "road", "대로변": "avenue", "car": "car", "vehicle": "vehicle", "자동차": "car", "truck": "truck", "bus": "bus",
    "bicycle": "bicycle", "자전거": "bicycle", "dog": "dog", "개": "dog", "cat": "cat", "고양이": "cat", "sea": "sea", "ocean": "sea", "beach": "beach", "바다": "sea", "해변": "beach",
    "building": "building", "건물": "building", "rain": "rain", "snow": "snow", "fog": "fog", "crosswalk": "crosswalk", "횡단보도": "crosswalk", "indoor": "indoor", "outdoor": "outdoor",
}

TOKEN = "[0-9A-Za-z가-힣]+"
LATIN = "^[0-9A-Za-z]+$"
STEM = "^(.+?)(?:" + "|".join(sorted(PARTICLES, key=lambda p: (-len(p), p))) + ")$"
EMPTY = "∅"  # the one token of a document without tokens


def _strings(*items: Column) -> Column:
    return F.array(*items) if items else F.array().cast("array<string>")


def _lookup(table: dict, key: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def tokenize(text: Column) -> Column:
    """Runs of digits, Latin letters and Hangul; ASCII ones in lower case; without stopwords. Null gives none."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)
    lowered = F.transform(runs, lambda t: F.when(t.rlike(LATIN), F.lower(t)).otherwise(t))
    return F.filter(lowered, lambda t: ~t.isin(STOPWORDS))


def strip_particle(token: Column) -> Column:
    """The token without its longest particle, at least one character staying."""
    return F.regexp_replace(token, STEM, "$1")


def char_ngrams(token: Column, n: int) -> Column:
    starts = F.when(F.length(token) >= n, F.sequence(F.lit(1), F.length(token) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(token, i, F.lit(n)))


def _forms(text: Column) -> Column:
    """Tokens of a text as (t, s): the token and its form without particle. Only Hangul has particles."""
    return F.transform(tokenize(text), lambda t: F.struct(t.alias("t"), F.when(t.rlike(LATIN), t).otherwise(strip_particle(t)).alias("s")))


def _translations(form: Column) -> Column:
    """What the token and the form without particle translate to; twice if they are the same. All keys are Hangul."""
    found = F.concat(F.coalesce(_lookup(TRANSLATIONS, form["t"]), _strings()), F.coalesce(_lookup(TRANSLATIONS, form["s"]), _strings()))
    return F.when(form["t"].rlike(LATIN), _strings()).otherwise(found)


def lexical_tokens(text: Column) -> Column:
    """Tokens for keyword search: each token, its form without particle if another, and the translations."""

    def spread(x: Column) -> Column:
        return F.when(x["t"].rlike(LATIN), F.array(x["t"])).otherwise(F.concat(F.array_distinct(F.array(x["t"], x["s"])), _translations(x)))

    return F.flatten(F.transform(_forms(text), spread))


def with_form(tokens: DataFrame) -> DataFrame:
    """Adds ``form``, a struct of a token ``t`` and its form without particle, to a table of tokens.

    What needs these for every use of a token should count equal tokens first: a table of tokens is compiled code, nested
    functions over arrays aren't.
    """
    return tokens.withColumn("form", F.struct("t", F.when(F.col("t").rlike(LATIN), F.col("t")).otherwise(strip_particle(F.col("t"))).alias("s")))


def lexical_forms(form: Column) -> Column:
    """What :func:`lexical_tokens` makes of one token."""
    return F.when(form["t"].rlike(LATIN), F.array(form["t"])).otherwise(F.concat(F.array_distinct(F.array(form["t"], form["s"])), _translations(form)))


def expand_query(text: Column) -> Column:
    """The different tokens, forms and translations of a query in order, or the query itself if there are none."""
    terms = F.array_distinct(lexical_tokens(text))
    return F.when(F.size(terms) > 0, F.array_join(terms, " ")).otherwise(text)


def concept_hints(text: Column) -> Column:
    """Concepts that a text names, each once, in order."""
    hits = F.transform(_forms(text), lambda x: F.coalesce(_lookup(CONCEPTS, x["t"]), F.when(x["s"] != x["t"], _lookup(CONCEPTS, x["s"]))))
    return F.array_distinct(F.filter(hits, lambda c: c.isNotNull()))


def features_of(form: Column) -> Column:
    """Weighted features of a token: the word 3, its form without particle and translations 2, bigrams 1, trigrams 0.7."""

    def feature(kind: str, weight: float):
        return lambda x: F.struct(F.concat(F.lit(kind), x).alias("feature"), F.lit(weight).alias("weight"))

    t, stem = form["t"], form["s"]
    return F.concat(
        F.transform(F.array(t), feature("w:", 3.0)),
        F.transform(F.when(stem != t, F.array(stem)).otherwise(_strings()), feature("w:", 2.0)),
        F.transform(_translations(form), feature("w:", 2.0)),
        F.transform(char_ngrams(t, 2), feature("g2:", 1.0)),
        F.transform(char_ngrams(t, 3), feature("g3:", 0.7)),
    )


def feature_tokens(text: Column) -> Column:
    """Weighted features of the tokens of a text, in order."""
    return F.flatten(F.transform(_forms(text), features_of))


def hash_bucket(feature: Column, dim: int) -> Column:
    """Bucket of a feature: the first four bytes of its md5, little-endian, modulo ``dim``."""
    h = F.md5(feature.cast("binary"))
    little = F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)])
    return (F.conv(little, 16, 10).cast("long") % dim).cast("int")


def collapse(text: Column) -> Column:
    """White space collapsed to single spaces and stripped."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def negated(query: Column, name: Column) -> Column:
    """Whether the first mention of ``name`` comes with a negation: Korean within 6 characters after it, English within 14 before it."""
    at = F.instr(query, name)
    tail = F.substring(query, at + F.length(name), F.lit(6))
    start = F.greatest(F.lit(1), at - 14)
    head = F.lower(F.substring(query, start, at - start))
    after = tail.rlike("없는|없이|제외|말고|빼고|아닌")
    before = head.rlike("without|no |not |except|excluding|minus")
    return F.when(at > 0, after | before)
