"""Spellings: split names, placeholders, persons, firms and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Names of the three splits whatever their case and spaces.
SPLIT_NAMES = {
    "train": ("train", "training", "trn", "tr"),
    "validation": ("validation", "valid", "val", "dev", "development", "validate"),
    "test": ("test", "testing", "tst", "te"),
}
#: Words that stand for an absent value.
PLACEHOLDERS = r"^(?:(?:unknown|anonymous|unnamed|unspecified|undisclosed|undefined|missing|none|null|nil|nan|na|n a|tbd|tba|tbc|x+|not (?:stated|available|given|known|specified|applicable|provided|disclosed|found)|no)(?: (?:author|authors|entity|company|name|person|source|document|file|id|group|value|issuer))?)$"
#: Titles of persons.
TITLES = "dr prof professor mr mrs ms miss mx sir dame md phd dphil cpa cfa mba esq jr sr dipl ing mag hon rev herr frau mme mlle".split()
#: Legal forms of firms, after punctuation is gone.
LEGAL_FORMS = "inc incorporated corp corporation co company ltd limited llc llp lp plc gmbh ag kg se sa sas sarl srl spa nv bv ab as asa oy oyj pty pte kk".split()


def split_name(raw: Column) -> Column:
    """train, validation or test; null where the name is none of them."""
    s = F.lower(F.regexp_replace(raw, r"(?U)[\s_\-.]+", ""))
    named = F.lit(None).cast("string")
    for name, spellings in SPLIT_NAMES.items():
        named = F.when(s.isin(*spellings), name).otherwise(named)
    return named


def plain(raw: Column) -> Column:
    """Lower case, single spaces; null for blank and placeholder values."""
    s = F.trim(F.regexp_replace(F.lower(raw), r"(?U)[\s\x{200b}\x{feff}]+", " "))
    bare = F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))
    return F.when((bare == "") | bare.rlike(PLACEHOLDERS), None).otherwise(s)


def person(raw: Column) -> Column:
    """A name whatever the order of its parts, without titles."""
    words = F.split(F.trim(F.regexp_replace(plain(raw), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.nullif(F.array_join(F.array_sort(F.filter(words, lambda w: ~w.isin(*TITLES))), " "), F.lit(""))


def firm(raw: Column) -> Column:
    """A firm's name without article and legal form."""
    s = F.trim(F.regexp_replace(F.regexp_replace(plain(raw), r"[.'’]", ""), r"[^\p{L}\p{N}]+", " "))
    s = F.regexp_replace(s, r"^the ", "")
    forms = "|".join(LEGAL_FORMS)
    return F.nullif(F.regexp_replace(s, rf"(?<=.)(?: (?:{forms}|and co))+$", ""), F.lit(""))


def folder(raw: Column) -> Column:
    """The folder of a path, whatever its slashes and case; null for a file without folder."""
    s = F.regexp_replace(F.replace(plain(raw), F.lit("\\"), F.lit("/")), r"/+", "/")
    s = F.regexp_replace(F.regexp_replace(s, r"(?:^|(?<=/))(?:\./)+", ""), r"^/|\s+(?=/)|(?<=/)\s+", "")
    return F.nullif(F.regexp_extract(s, r"^(.+)/[^/]*$", 1), F.lit(""))
