"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A term counts where it stands alone: no letter or digit of any script touches it (Chinese, Japanese and Korean terms, whose words
aren't set apart, count anywhere). Terms have weights: a strict one has 1, a soft one less; a URL is blocked if the weights of its
different terms sum to 1 or more, so by one strict term or several different soft ones. Allow and block rules name a host suffix and a
path prefix; the longest rule that fits decides before the vocabulary does.

The vocabulary is a parameter, as lists or as a table (term, weight) of at most TERMS rows; the one below is of our own choice.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the vocabulary
(a null one is allowed). Terms are compared in lower case; overlapping ones each count; null and empty terms are none, a term that is
there twice has its largest weight. Repeated rows get equal verdicts; very long URLs are read whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tables import arrow_map, parquet

#: Terms of our own choice, in lower case: English, then Spanish, French, German, Russian.
STRICT = ["porn", "porno", "xxx", "hentai", "escort", "escorts", "camgirl", "camgirls", "viagra", "cialis", "warez", "malware", "phishing", "pornografia", "putas", "pornographie", "pornos", "порно", "виагра"]
SOFT = [
    "ad", "ads", "adult", "advert", "affiliate", "banner", "bet", "betting", "casino", "click", "clickbait", "crack", "dating", "free", "gambling", "hot", "jackpot", "keygen", "loan", "lottery", "nude", "pills", "poker", "popup", "promo", "sex", "sexy", "slots", "spam", "sponsor", "torrent", "track", "tracker", "tracking", "win",
    "apuestas", "gratis", "loteria", "prestamos", "publicidad", "sexo", "tragaperras", "gratuit", "loterie", "pari", "publicite", "rencontres", "sexe", "gewinnspiel", "kostenlos", "kredit", "lotterie", "werbung", "wetten", "бесплатно", "казино", "ставки", "секс",
]
SOFT_LIMIT = 2
#: Most terms of a vocabulary: the automaton is made in every task.
TERMS = 500_000
#: (host suffix, path prefix, verdict), fixed by the query's contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@dataclass(frozen=True)
class Vocabulary:
    """Weight of each term; ``decode``: read percent-encoded characters as what they stand for."""

    weights: dict[str, float] = field(default_factory=dict)
    decode: bool = False

    @staticmethod
    def of(strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT, limit: int = SOFT_LIMIT, decode: bool = False) -> Vocabulary:
        """Strict terms and soft ones, ``limit`` different ones of which block."""
        return Vocabulary({t.lower(): 1.0 / limit for t in soft if t} | {t.lower(): 1.0 for t in strict if t}, decode)

    @staticmethod
    def table(terms: DataFrame, decode: bool = False) -> Vocabulary:
        """From a table (term, weight)."""
        rows = terms.select(F.lower(F.col("term").cast("string")).alias("term"), F.col("weight").cast("double").alias("weight")).where("term <> '' and weight > 0")
        got = rows.groupBy("term").agg(F.max("weight").alias("weight")).limit(TERMS + 1).collect()
        if len(got) > TERMS:
            raise ValueError(f"a vocabulary has at most {TERMS} terms")
        return Vocabulary({r.term: r.weight for r in got}, decode)


def _joined(c: str) -> bool:
    """Whether words of this character's script are written without spaces."""
    return "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7af" or "\U00020000" <= c <= "\U0003ffff"


def automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t, w in vocabulary.weights.items():
        a.add_word(t, (t, w, _joined(t[0]), _joined(t[-1])))
    a.make_automaton()
    return a


def hits(text: str, machine: ahocorasick.Automaton) -> tuple[int, dict[str, float]]:
    """Occurrences of strict terms, and the different soft terms with their weights, that no letter or digit touches."""
    strict, soft, n = 0, {}, len(text)
    if not len(machine):
        return strict, soft
    for end, (term, weight, free_left, free_right) in machine.iter(text):
        low = end - len(term)
        if (free_left or low < 0 or not text[low].isalnum()) and (free_right or end + 1 >= n or not text[end + 1].isalnum()):
            if weight >= 1:
                strict += 1
            else:
                soft[term] = weight
    return strict, soft


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.coalesce(F.translate(F.regexp_extract(url, at, 1), low, low.lower()), F.lit("")), F.coalesce(F.regexp_extract(url, at, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits. One conditional, longest rule first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def count_terms(rows: DataFrame, url: str, keys: list[str], vocabulary: Vocabulary | None = None) -> DataFrame:
    """``keys`` plus n_strict (occurrences), n_soft (different terms) and soft_weight (their sum) of every URL."""
    kept = rows.select(*keys, F.col(url).cast("string").alias("_url"))
    vocabulary = Vocabulary.of() if vocabulary is None else vocabulary
    machine: list = []

    def one(batch: pa.RecordBatch) -> dict:
        if not machine:
            machine.append(automaton(vocabulary))
        read = (lambda u: unquote(u, errors="replace")) if vocabulary.decode else (lambda u: u)
        got = [hits(read(u or "").lower(), machine[0]) for u in batch.column(len(keys)).to_pylist()]
        return {k: batch.column(i) for i, k in enumerate(keys)} | {"n_strict": [x[0] for x in got], "n_soft": [len(x[1]) for x in got], "soft_weight": [sum(x[1].values()) for x in got]}

    types = dict(kept.dtypes)
    return arrow_map(kept, one, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_strict long, n_soft long, soft_weight double")


def judge(rows: DataFrame, url: str = "url", id_col: str = "page_id", rules: list[tuple[str, str, str]] = RULES, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Host, path, rule and verdict of every URL. The URL goes to Python once; nothing is shuffled."""
    h, p = split_url(F.col(url))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = rows.select(F.col(id_col).alias(id_col), F.col(url).alias("url"), h.alias("host"), p.alias("path"))
    got = count_terms(base, "url", [id_col, "host", "path"], vocabulary)
    # sums of thirds and the like fall short of 1 by rounding
    blocked = F.when((F.col("n_strict") >= 1) | (F.col("soft_weight") >= 1 - 1e-9), "block").otherwise("allow")
    return got.select(id_col, "host", "path", name.alias("rule"), F.coalesce(verdict, blocked).alias("verdict"), "n_strict", "n_soft")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(parquet(spark, sf_dir, "pages"))


def _sql() -> str:
    # as the text: each character between letters and digits is two spaces, so that neighbours don't share one
    spaced = lambda t: "".join(c if c.isalnum() else "  " for c in t)
    strict = "+".join(f"len(regexp_extract_all(p, ' {spaced(t)} '))" for t in STRICT)
    soft = "+".join(f"(contains(p, ' {spaced(t)} '))::INT" for t in SOFT)
    order = sorted(RULES, key=lambda r: -(len(r[0]) + len(r[1])))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in order]
    name = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + f" WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
  ' ' || regexp_replace(lower(url), '[^\\p{{L}}\\p{{N}}]', '  ', 'g') || ' ' AS p FROM u),
c AS (SELECT *, ({strict})::BIGINT AS n_strict, ({soft})::BIGINT AS n_soft FROM s)
SELECT page_id, host, path, {name} AS rule, {verdict} AS verdict, n_strict, n_soft FROM c
"""


OP8_SQL = _sql()
