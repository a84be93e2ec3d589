"""Features read off a path by ordered rules. The rules are data; the expressions are built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered instrument patterns, the type, tempo and key patterns, and the sharps of flat notes.
INSTRUMENTS = (
    ("808", r"\b808s?\b|sub ?bass"),
    ("kick", r"\bkick|\bbd\b|bass ?drum|\bkik\b"),
    ("snare", r"\bsnare|\bsd\b|\brim|rimshot"),
    ("clap", r"\bclap|\bclp\b"),
    ("hihat", r"\bhi ?hats?|\bhats?\b|\bhh\b|open ?hat|closed ?hat|\bohh\b|\bchh\b"),
    ("cymbal", r"\bcymbal|\bcrash|\bride\b|\bsplash"),
    ("tom", r"\btoms?\b"),
    ("perc", r"\bperc|percussion|conga|bongo|shaker|tambourine|\bclave|cowbell|woodblock"),
    ("vocal", r"\bvocal|\bvox\b|\bacapella|acappella|\bchant|\bchoir|\bphrase\b|\badlib"),
    ("bass", r"\bbass\b|reese|\bsub\b"),
    ("fx", r"\bfx\b|\briser|\bdownlifter|\bimpact|\bsweep|\bwhoosh|foley|ambien|\bnoise\b|\bsfx\b|texture|drone"),
    ("synth", r"\bsynth|\blead\b|\bpluck|\barp\b|\bpad\b|\bkeys?\b|\bpiano|\bguitar|\bbrass|\bstring|\bbell|\bchord"),
    ("drums", r"\bdrums?\b|\bbreak(beat)?s?\b|\bgroove\b"),
)
ONESHOT = r"\bone[ _-]?shots?\b|\bhits?\b|\bstabs?\b"
LOOP = r"\bloops?\b|\bbreak(beat)?s?\b|groove"
BPM = r"(?<!\d)(\d{2,3})\s?bpm\b"
KEY = r"(?<![A-Za-z])([A-G])[ _]?(#|b)?[ _]?((?i:maj(?:or)?|min(?:or)?|m))?\b"
KEY_WORD = r"maj|min|chord|melod|key|scale"
KEY_NOTE = r"[A-G](#|b)?m?\b"
SHARPS = (("Cb", "B"), ("Db", "C#"), ("Eb", "D#"), ("Fb", "E"), ("Gb", "F#"), ("Ab", "G#"), ("Bb", "A#"))
BPM_RANGE = (40, 300)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def first_rule(text: Column, rules=INSTRUMENTS) -> Column:
    """The name of the first rule whose pattern is found, else null."""
    return F.coalesce(*(F.when(text.rlike(f"(?i){pattern}"), F.lit(name)) for name, pattern in rules))


def sample_type(path: Column) -> Column:
    text = F.lower(path)
    return F.when(text.rlike(f"(?i){ONESHOT}"), F.lit("oneshot")).when(text.rlike(f"(?i){LOOP}"), F.lit("loop"))


def bpm(path: Column) -> Column:
    """Beats per minute from the base name, else from the whole path; a number out of range isn't sought elsewhere."""
    number = lambda t: F.nullif(F.regexp_extract(F.lower(t), f"(?i){BPM}", 1), F.lit("")).try_cast("int")
    found = F.coalesce(number(basename(path)), number(path))
    return F.when(found.between(*BPM_RANGE), found)


def musical_key(path: Column) -> Column:
    """Note with sharp and ``m`` for minor, such as ``F#m``; null if the base name hints at no key."""
    base = basename(path)
    group = lambda k: F.regexp_extract(base, KEY, k)
    note = F.when(group(2) == "b", F.coalesce(*(F.when(group(1) == flat[0], F.lit(sharp)) for flat, sharp in SHARPS))).otherwise(F.concat(group(1), group(2)))
    quality = F.lower(group(3))
    minor = quality.startswith("m") & ~quality.startswith("maj")
    hinted = F.lower(base).rlike(f"(?i){KEY_WORD}") | base.rlike(KEY_NOTE)
    return F.when(hinted & (group(1) != ""), F.concat(note, F.when(minor, "m").otherwise("")))


def path_hints(path: Column) -> list[Column]:
    """instrument, sample_type, bpm and key of a path."""
    return [first_rule(F.lower(path)).alias("instrument"), sample_type(path).alias("sample_type"), bpm(path).alias("bpm"), musical_key(path).alias("key")]


# Sound-event categories by the words found in an event's name.
EVENT_CATEGORIES = (
    ("snare", ("snare",)),
    ("kick", ("bass drum",)),
    ("hihat", ("hi-hat",)),
    ("cymbal", ("cymbal", "crash")),
    ("drums", ("drum kit", "drum machine", "drum roll", "drumming", "drums")),
    ("clap", ("clapping", "hands", "finger snapping")),
    ("perc", ("cowbell", "tambourine", "maraca", "wood block", "rattle", "percussion", "tabla", "conga", "bongo", "gong")),
    ("bass", ("bass guitar", "double bass", "bass (instrument)")),
    ("synth", ("synthesizer", "sawtooth", "electronic music")),
    ("vocal", ("singing", "choir", "vocal", "chant", "rapping", "yodeling", "speech", "humming")),
    ("tonal", ("piano", "keyboard", "organ", "guitar", "banjo", "mandolin", "ukulele", "violin", "cello", "string", "orchestra", "trumpet", "brass", "trombone", "saxophone", "horn", "flute", "clarinet", "bell", "chime", "vibraphone", "marimba", "xylophone", "glockenspiel", "harp", "accordion")),
    ("fx", ("gunshot", "explosion", "glass", "shatter", "siren", "noise", "wind", "rain", "thunder", "engine", "vehicle", "whoosh")),
)


def event_category(name: Column) -> Column:
    text = F.lower(name)
    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, (text.contains(w) for w in words)), F.lit(category)) for category, words in EVENT_CATEGORIES))


def score_category(scores: Column, labels: Column, topk: int = 8) -> Column:
    """struct<category, score>: the best-scored of the ``topk`` labels that has a category; null if none has."""
    ranked = F.slice(F.sort_array(F.arrays_zip(scores.alias("score"), labels.alias("label")), asc=False), 1, topk)
    named = F.transform(ranked, lambda x: F.struct(event_category(x["label"]).alias("category"), x["score"].alias("score")))
    return F.try_element_at(F.filter(named, lambda x: x["category"].isNotNull()), F.lit(1))
