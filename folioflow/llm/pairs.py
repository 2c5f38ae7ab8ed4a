"""Broken question-answer pairs: clauses tagged by a conditional random field.

An answer is cut into clauses. A chain CRF tags each as answer, refusal, echo (of
the question), foreign (another language than the question), unfinished or
stand-in (for an answer); the share of the answer that each tag covers gives the
defects of the pair.

The CRF is trained here, on a bounded sample of pairs without visible defect,
damaged in known ways: cut off, replaced by their question, by an answer to a
question in another language, by a refusal of a small grammar or by a stand-in. Its features
are linguistic cues and corpus statistics: how often a word ends a sentence, and
whether a last word is only the beginning of a known one. The statistics are
counted over all pairs and reach the answers by joins on their last words.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.crf import ChainCRF
from folioflow.runtime import cut

LABELS = ["answer", "refusal", "echo", "foreign", "unfinished", "stand-in"]

# Frequent function words of the five languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for as with on by at from are was be this which not or an a its their when what how does do has have but only we every than more no yes".split(),
    "de": "der die das und zu in ist den von mit sich des auf für nicht ein eine dem im als auch es an werden aus er hat dass sie nach wird bei einer um am noch wie über ohne nur warum welche was zur zum vor".split(),
    "fr": "le la les des de et à un une du en est que qui dans pour pas sur au par plus ne se ce il sont avec sans son ses cette aux ou mais comme nous l d s n qu quelles quel pourquoi comment été".split(),
    "es": "el la los las de y en que un una por con para es del se no al lo como más su sus pero sin sobre este esta son entre también qué cómo cuál una hay según aunque ha".split(),
    "ru": "и в не на что с по как из за это от для к до же но его только при или так если она они мы у о об бы был было без какие почему как чем со".split(),
}
#: Words on which no sentence ends (fixed values): articles, prepositions, conjunctions.
DANGLING = {
    "en": "the of and to in that for as with on by at from an a its their which or but than every each when while because into per such".split(),
    "de": "der die das und zu in den von mit des auf für ein eine dem im als auch werden aus dass nach bei einer um am wie über ohne zur zum vor".split(),
    "fr": "le la les des de et à un une du en que qui dans pour sur au par ne se ce avec sans son ses cette aux ou mais comme".split(),
    "es": "el la los las de y en que un una por con para del al como su sus pero sin sobre este esta entre aunque".split(),
    "ru": "и в не на что с по как из за от для к до но при или если со об".split(),
}
#: Cues of a refusal (fixed values, lower case): who speaks, that they can't or won't, what they are asked for.
SPEAKER = r"\b(?:i|i’m|i'm|i’d|i'd|i’ve|me|my|ich|mir|mich|je|j’|me|m’|m'|moi|yo|mí|puedo|dispongo|tengo|debo|я|мне|меня)\b|\bj[’']|\bm[’']"
UNABLE = (
    r"can[’']?t|cannot|can not|unable|not able|won[’']?t|not possible|impossible|must decline|decline to|have to (?:decline|pass)|rather not|"
    r"prefer not|not allowed|may not|refuse to|no answer can|do not have|don[’']?t have|no access|outside (?:of )?what|beyond what|not in a position|"
    r"kann (?:\w+ ){0,4}nicht|nicht (?:beantworten|möglich|sagen)|darf (?:\w+ ){0,5}(?:nicht|nichts|keine)|keine (?:auskunft|angaben|informationen|antwort)|leider|"
    r"ne (?:peux|puis|suis|dispose|saurais|souhaite)|n[’']ai pas|impossible|pas en mesure|refuse|"
    r"no (?:puedo|me es posible|dispongo|tengo|es posible|estoy)|imposible|"
    r"не (?:могу|имею|в состоянии|готов|смогу|вправе|располагаю)|невозможно|нет доступа|вынужден"
)
APOLOGY = (
    r"sorry|apolog\w+|unfortunately|regret|thank you for asking|thanks for asking|as an ai|as a language model|ai model|assistant|"
    r"entschuldig\w+|tut mir leid|bedaure|leider|als ki|désolée?|excuse\w*|malheureusement|regrette|en tant qu|"
    r"lo siento|lamento|disculp\w+|perd[oó]n|lamentablemente|como (?:ia|modelo)|извин\w+|к сожалению|прошу прощения|сожале\w+|как ии"
)
ASKED = (
    r"answer|assist|help|respond|reply|comment|say|tell|speculate|provide|question|request|full text|the paper|elsewhere|another source|the authors instead|anything else|"
    r"beantwort\w*|auskunft|frage|helfen|antwort\w*|sagen|text|répondre|réponse|question|aider|texte|article|dire|"
    r"responder|respuesta|pregunta|ayudar|texto|decir|contestar|ответ\w*|вопрос\w*|помочь|текст\w*|сказать"
)
#: Stand-ins for an answer (fixed values), compared without case, outer signs and white space.
STAND_INS = frozenset(
    "n/a na n.a none null nil nan tbd tba todo unknown undefined empty no answer not available not applicable no response missing pending "
    "keine antwort k.a sans réponse sin respuesta нет ответа".split()
) | {"no answer", "not available", "not applicable", "no response", "no data", "keine antwort", "keine angabe", "sans réponse", "sin respuesta", "нет ответа", "н/д", "k. a"}

_STAND_IN_WORDS = frozenset({"no", "not", "answer", "response", "available", "applicable", "keine", "antwort", "sans", "réponse", "sin", "respuesta", "нет", "ответа"})
STAND_INS = STAND_INS - _STAND_IN_WORDS
_SPEAKER, _UNABLE, _APOLOGY, _ASKED = (re.compile(p, re.IGNORECASE) for p in (SPEAKER, UNABLE, APOLOGY, ASKED))
_WORD = re.compile(r"[^\W_]+(?:[-’'.][^\W_]+)*")
_LABEL = re.compile(r"^\s*(?:answer|a|antwort|réponse|respuesta|ответ)\s*[:：]\s*", re.IGNORECASE)
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"")
_CLAUSE = re.compile(r"(?<=[.!?…])[\"”’»)]*\s+(?=[\"“„«(\[]?[^\Wa-zа-яß-ÿ])|\n+")
_ABBREVIATION = re.compile(r"(?:\b(?:Dr|Prof|Mr|Ms|Fig|Sec|Eq|Tab|cf|vs|bzw|e\.g|i\.e|z\.B|Nr|No)\.|\b[A-Z]\.)$")
_CLOSED = re.compile(r"[.!?][\"”’»)\]]*$|[。！？]$")
_HANGING = re.compile(r"[,;:\-–—(\[„“«/]\s*$|[(\[]\d*$|\n[-*•]$")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.)$")


def bare(answer: str) -> str:
    """The answer without label, mark-up tags, invisible characters and white space at both ends."""
    text = "".join(" " if unicodedata.category(c) in ("Zs", "Cc") and c != "\n" else c for c in answer if unicodedata.category(c) != "Cf")
    text = re.sub(r"</?\w+>", "", text).strip()
    return _LABEL.sub("", text).strip()


def is_empty(answer: str | None) -> bool:
    """Whether an answer is null, blank or only a stand-in."""
    return answer is None or stands_in(bare(answer))


def stands_in(text: str) -> bool:
    """Whether a text holds nothing but signs or a stand-in."""
    core = re.sub(r"^[\W_]+|[\W_]+$", "", text).lower()
    return not core or core in STAND_INS


def clauses(text: str) -> list[str]:
    """Sentences and lines, in order; a cut after an abbreviation is undone."""
    out: list[str] = []
    for part in _CLAUSE.split(text):
        part = part.strip()
        if not part:
            continue
        if out and _ABBREVIATION.search(out[-1]):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def unbalanced(text: str) -> bool:
    """Whether a bracket or quotation mark stays open."""
    return any(text.count(a) > text.count(b) for a, b in ("“”", "()", "[]", "«»", "„“")) or text.count('"') % 2 == 1


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def last_word(text: str) -> str:
    """The last word as written, or nothing if the text doesn't end in one (but for a stop or ellipsis)."""
    m = re.search(r"([^\W_]+(?:[-’'][^\W_]+)*)[\s.…]*$", text)
    return m.group(1) if m else ""


def languages(text: str) -> dict[str, float]:
    """Evidence for each language: shares of its function words and letters."""
    free = _QUOTED.sub(" ", text)
    found = re.findall(r"[^\W\d_]+", free.lower())
    out = {}
    for lang, known in _KNOWN.items():
        out[lang] = float(sum(w in known for w in found))
    cyrillic = len(re.findall(r"[а-яё]{2,}", free.lower()))
    out["ru"] += 1.5 * cyrillic
    out["de"] += 1.0 * len(re.findall(r"[äöüß]", free.lower()))
    out["fr"] += 0.8 * len(re.findall(r"[èêçœùâîôû]|\b[ldsnqj]’", free.lower()))
    out["es"] += 1.2 * len(re.findall(r"[ñ¿¡óíáú]|ción\b", free.lower()))
    return out


_KNOWN = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_DANGLES = {k: frozenset(v) for k, v in DANGLING.items()}


def shared(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists, bit-parallel: a long integer holds a row of the table."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if same := row & places.get(y, 0):
            row = ((row + same) | (row - same)) & full
    return len(a) - row.bit_count()


WIDTH = 25
#: Share of a word's inner uses from which its closing uses count as established.
CLOSING_SHARE = 0.02


def features(question: str, answer: str, closing: float, inner: float) -> tuple[list[str], np.ndarray]:
    """The clauses and their features. ``closing``: how often the answer's last word ends
    sentences or answers; ``inner``: how often words that begin with it stand inside sentences."""
    usual = closing >= CLOSING_SHARE * inner and closing > 1
    open_end = inner >= 5 and not usual
    parts = clauses(answer)
    asked = words(question)
    own = languages(question)
    mine = max(own, key=lambda k: own[k])
    x = np.zeros((len(parts), WIDTH))
    whole = words(answer)
    nothing = stands_in(answer)
    novel = 1 - shared(whole, asked) / max(1, len(whole))
    stranger = languages(answer)
    away = max((v for k, v in stranger.items() if k != mine), default=0.0)
    for i, part in enumerate(parts):
        free = _QUOTED.sub(" ", part)
        w = words(part)
        speaker, unable, sorry, task = (bool(p.search(free)) for p in (_SPEAKER, _UNABLE, _APOLOGY, _ASKED))
        common = shared(w, asked)
        covers, fresh = common / max(1, len(asked)), 1 - common / max(1, len(w))
        lang = languages(part)
        other = max((v for k, v in lang.items() if k != mine), default=0.0)
        final = i == len(parts) - 1
        closed = bool(_CLOSED.search(part)) and not _ELLIPSIS.search(part)
        last = last_word(part)
        low = last.lower()
        dangling = any(low in d and own[k] >= 0 and k == max(lang, key=lambda z: lang[z]) for k, d in _DANGLES.items()) and not part.endswith((".", "!", "?"))
        open_ = unbalanced(part)
        hanging = bool(_HANGING.search(part))
        titled = [t[0].isupper() for t in re.findall(r"[^\W\d_]{4,}", free)]
        complete = len(titled) >= 4 and all(titled[-2:]) and sum(titled) >= 0.75 * len(titled)
        ellipsis = bool(_ELLIPSIS.search(_QUOTED.sub("x", part)))
        x[i] = [
            1.0, final, i == 0, min(len(w), 30) / 30,
            sorry, unable and speaker, unable and task, speaker and unable and task, sorry and speaker, unable and not speaker and not sorry,
            covers, fresh, covers >= 0.75 and fresh <= 0.25, novel <= 0.25,
            other > lang[mine], min(3.0, max(0.0, other - lang[mine])) / 3, away > stranger[mine] + 1, lang[mine] > other,
            final and not closed, final and not closed and usual, final and not closed and open_end and not complete, final and dangling and not closed,
            final and not closed and (open_ or hanging), final and ellipsis, nothing,
        ]
    return parts, x


# ---------------------------------------------------------------------------
# Corpus statistics


def word_statistics(marked: DataFrame) -> DataFrame:
    """(word, seen, closing) over all answers: how often a word was seen, and how often it closed.

    ``closing``: how often the word is the last of a sentence with a stop, or the last of
    an answer without one.
    """
    answers = marked.filter(~F.col("empty")).select("answer", "last")
    tokens = answers.select(F.explode(F.split(F.regexp_replace("answer", r"\s+", " "), " ")).alias("t"))
    counted = (
        tokens.select(
            F.lower(F.regexp_extract("t", r"([\p{L}\p{N}]+(?:[-’'][\p{L}\p{N}]+)*)[^\p{L}\p{N}]*$", 1)).alias("word"),
            F.col("t").rlike(r"[.!?][\"”’»)\]]*$").cast("long").alias("stop"),
        )
        .filter("word <> ''")
        .groupBy("word")
        .agg(F.count("*").alias("seen"), F.sum("stop").alias("stops"))
    )
    bare_ends = answers.filter("last <> ''").groupBy(F.col("last").alias("word")).agg(F.count("*").alias("bare"))
    return cut(
        counted.join(bare_ends, "word", "full").select(
            "word",
            F.coalesce("seen", F.lit(0)).alias("seen"),
            (F.coalesce("stops", F.lit(0)) + F.coalesce("bare", F.lit(0))).alias("closing"),
        )
    )
def _facts(wanted: DataFrame, statistics: DataFrame) -> DataFrame:
    """(word, closing, inner) for the wanted words; unknown ones have 0.

    ``inner``: how often words that begin with the wanted one (or are it) stand inside
    sentences; words with digits begin with none. It counts tenfold for what is
    never a word itself inside sentences: the beginning of a word must close many
    answers to be believed. Of a word's beginnings only those are formed that are
    as long as a wanted word.
    """
    inside = F.col("seen") > F.col("closing")
    lengths = wanted.agg(F.collect_set(F.length("word")).alias("lengths"))
    begun = statistics.filter(inside & ~F.col("word").rlike(r"\d")).join(F.broadcast(lengths))
    begun = begun.select(F.explode(F.filter("lengths", lambda n: n <= F.length("word"))).alias("k"), "word", (F.col("seen") - F.col("closing")).alias("inner"))
    openings = begun.groupBy(F.expr("substring(word, 1, k)").alias("word")).agg(F.sum("inner").alias("inner"))
    closings = statistics.select("word", "closing", inside.alias("known"))
    return (
        wanted.join(closings, "word", "left")
        .join(openings, "word", "left")
        .select("word", F.coalesce("closing", F.lit(0)).cast("double").alias("closing"), (F.coalesce("inner", F.lit(0)) * F.when(F.col("known"), 1.0).otherwise(10.0)).alias("inner"))
    )


def _marked(pairs: DataFrame, question_col: str, answer_col: str, id_col: str) -> DataFrame:
    """(id, question, answer, last): the last word of answers that end without a stop, marked in ``answer``."""

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            text = [bare(a) if a is not None else "" for a in x["raw"]]
            empty = [is_empty(a) for a in x["raw"]]
            last = [last_word(t).lower() if t and not (_CLOSED.search(t) and not _ELLIPSIS.search(t)) else "" for t in text]
            yield pd.DataFrame({"id": x["id"], "question": [q or "" for q in x["question"]], "answer": text, "empty": empty, "last": last})

    # Ids travel as strings: a null among numbers would turn them into floats.
    raw = pairs.select(F.col(id_col).cast("string").alias("id"), F.col(question_col).alias("question"), F.col(answer_col).alias("raw"))
    return raw.mapInPandas(prepare, "id string, question string, answer string, empty boolean, last string")


def _with_statistics(marked: DataFrame, statistics: DataFrame) -> DataFrame:
    """Adds (closing, inner) of the last word to every pair, by joins; 0 where an answer ends with a stop."""
    facts = cut(_facts(marked.filter("last <> ''").select(F.col("last").alias("word")).distinct(), statistics))
    plain = marked.filter("last = ''").withColumns({"closing": F.lit(0.0), "inner": F.lit(0.0)})
    ended = marked.filter("last <> ''").join(facts.withColumnRenamed("word", "last"), "last")
    return plain.unionByName(ended.select(*plain.columns))


# ---------------------------------------------------------------------------
# Training


#: A small grammar of refusals (fixed values): openings, cores and endings by language.
REFUSALS = {
    "en": (
        ["", "", "", "I’m sorry, but ", "Sorry, ", "Unfortunately, ", "Apologies. ", "Thank you for asking, but ", "I apologise; "],
        ["I can’t answer that", "I am unable to say how this works", "it is not possible for me to respond here", "no answer can be given by me", "I won’t be able to assist with this question",
         "as an AI model I must decline", "I do not have access to the full text", "I have to pass on this one", "I would rather not comment on this", "this is outside what I can help with"],
        ["", ".", ". Please consult the authors instead.", ". Is there anything else you need?", " at this time.", " without the paper."],
    ),
    "de": (["", "Leider ", "Es tut mir leid, "], ["kann ich diese Frage nicht beantworten", "liegen mir keine Informationen vor", "darf ich dazu keine Auskunft geben"], [".", ". Bitte fragen Sie die Autoren."]),
    "fr": (["", "Désolé, ", "Malheureusement, "], ["je ne peux pas répondre à cette question", "il m’est impossible de répondre", "je n’ai pas accès au texte"], [".", ". Veuillez consulter les auteurs."]),
    "es": (["", "Lo siento, ", "Lamentablemente, "], ["no puedo responder a esa pregunta", "no dispongo del texto completo", "no me es posible contestar"], [".", ". Consulte a los autores."]),
    "ru": (["", "Извините, ", "К сожалению, "], ["я не могу ответить на этот вопрос", "у меня нет доступа к тексту", "мне не разрешено об этом говорить"], [".", ". Обратитесь к авторам."]),
}


def damaged(sample: pd.DataFrame, seed: int = 3) -> Iterator[tuple[str, str, list[int] | int, int | None]]:
    """(question, answer, tags, last tag) of damaged and whole pairs.

    ``sample`` (question, answer): answers that close with a stop. One tag holds for
    all clauses, a list for the first ones, where the others are answers.
    """
    rng = random.Random(seed)
    rows = list(zip(sample["question"], sample["answer"]))
    by_lang: dict[str, list[str]] = {}
    langs = []
    for q, a in rows:
        own = languages(q)
        lang = max(own, key=lambda k: own[k])
        answered = languages(a)
        langs.append(lang)
        if max(answered, key=lambda k: answered[k]) == lang:
            by_lang.setdefault(lang, []).append(a)
    stand_ins = sorted(STAND_INS)
    for (q, a), lang in zip(rows, langs):
        own = languages(a)
        if own[lang] < max(own.values()) or _APOLOGY.search(_QUOTED.sub(" ", a)):
            continue
        yield q, a, 0, None
        if rng.random() < 0.5:  # sound without its stop
            yield q, a.rstrip("."), 0, None
        if len(a) > 12:
            yield q, a[: rng.randint(len(a) // 4, max(len(a) // 4 + 1, len(a) - 3))].rstrip(), 0, LABELS.index("unfinished")
        if rng.random() < 0.3:
            yield q, rng.choice([q, q.upper(), q.rstrip("?.!"), f"  {q}\n", f"You ask: {q}", f"**{q}**", q.replace(" the ", " ", 1)]), 2, None
        if rng.random() < 0.2:
            yield q, f"{q} {a}", [2] * len(clauses(q)), None
        others = [k for k in by_lang if k != lang]
        if others and rng.random() < 0.4:
            yield q, rng.choice(by_lang[rng.choice(others)]), 3, None
        for _ in range(rng.randint(0, 2)):
            start, core, end = (rng.choice(part) for part in REFUSALS[lang])
            text = start + core + end
            yield q, text[0].upper() + text[1:], 1, None
        if rng.random() < 0.15:  # regret is no refusal
            yield q, rng.choice([o for o in REFUSALS[lang][0] if o.rstrip().endswith(",")] or [""]) + a, 0, None
        if rng.random() < 0.1:
            yield q, rng.choice([str, str.upper, str.capitalize])(rng.choice(stand_ins)) + rng.choice(["", "."]), LABELS.index("stand-in"), None


def _open_word(answer: str) -> str:
    """The last word of an answer without a stop, else nothing."""
    return "" if _CLOSED.search(answer) and not _ELLIPSIS.search(answer) else last_word(answer).lower()


def training_set(pairs: Iterable[tuple[str, str, list[int] | int, int | None]], facts: dict[str, tuple[float, float]]) -> tuple[list[np.ndarray], list[list[int]]]:
    """Features and tags of :func:`damaged` pairs; ``facts``: (closing, inner) by last word.

    A pair cut where it may as well end is left out.
    """
    x: list[np.ndarray] = []
    y: list[list[int]] = []
    for q, a, tags, last_tag in pairs:
        last = _open_word(a)
        closing, inner = facts.get(last, (0.0, 0.0)) if last else (0.0, 0.0)
        if last_tag is not None and (_CLOSED.search(a) or not (closing < CLOSING_SHARE * inner or _HANGING.search(a) or unbalanced(a))):
            continue
        parts, f = features(q, a, closing, inner)
        if not parts:
            continue
        labels = [tags] * len(parts) if isinstance(tags, int) else (tags + [0] * len(parts))[: len(parts)]
        if last_tag is not None:
            labels[-1] = last_tag
        x.append(f)
        y.append(labels)
    return x, y


def _train(x: list[np.ndarray], y: list[list[int]]) -> ChainCRF | None:
    if not x:
        return None
    model = ChainCRF(LABELS, WIDTH)
    model.fit(x, y)
    return model


def defects(question: str, answer: str, closing: float, inner: float, model: ChainCRF | None) -> list[str]:
    """The defects of a pair, from the shares of the answer that the tags cover.

    Without a model (there was no sample to train it on) only blank answers and stand-ins are known.
    """
    parts, x = features(question, answer, closing, inner)
    if not parts or model is None:
        return ["empty"] if not parts or stands_in(answer) else []
    tags = [LABELS[t] for t in model.tag(x)]
    size = [max(1, len(p)) for p in parts]
    total = sum(size)
    share = {k: sum(n for t, n in zip(tags, size) if t == k) / max(1, total) for k in LABELS}
    if share["stand-in"] == 1:
        return ["empty"]
    # An unfinished clause belongs to what stands before it in other respects.
    rest = 1 - share["unfinished"]
    echoes = all(t == "echo" or t == "unfinished" and x[i, 11] <= 0.1 for i, t in enumerate(tags)) and x[-1, 3:].any()
    out = []
    given_back = echoes and (share["echo"] > 0 or x[0, 10] >= 0.5)
    if tags[-1:] == ["unfinished"]:
        # A question given back but for its end is cut off; without its last sign it is a copy.
        given_back = given_back and x[:, 10].sum() >= 0.9
        if not given_back:
            out.append("truncated")
    if share["refusal"] and (tags[0] == "refusal" or share["refusal"] >= 0.5):
        out.append("refusal")
    elif given_back:
        out.append("copy")
    if tags[-1:] == ["foreign"] and _breaks_off(x[-1], model):
        out.append("truncated")
    foreign = share["foreign"] / rest if rest > 0 else 0.0
    if foreign >= 0.5 or (rest <= 0 and x[0, 14] and x[0, 16]):
        out.append("other_language")
    return out


def _breaks_off(clause: np.ndarray, model: ChainCRF) -> bool:
    """Whether a last clause would be tagged unfinished rather than answer, were it in the right language."""
    own = clause.copy()
    own[14:18] = (0.0, 0.0, 0.0, 1.0)
    unary = own @ model.emit
    return bool(unary[LABELS.index("unfinished")] > unary[LABELS.index("answer")])


def broken_pairs(pairs: DataFrame, id_col: str = "id", question_col: str = "question", answer_col: str = "reference_answer", sample_rows: int = 1500) -> DataFrame:
    """(id, defect): one row for each pair and defect.

    Defects: empty (null, blank or a stand-in; then no other), truncated, refusal,
    copy, other_language. A null question counts as blank: nothing can be copied
    from it and no language is foreign to it. Repeated rows are each answered, an
    empty table gives no rows, other columns are ignored. ``sample_rows`` bounds the
    pairs that the CRF is trained on; statistics and tags cover all.
    """
    marked = cut(_marked(pairs, question_col, answer_col, id_col))
    statistics = word_statistics(marked)
    ready = cut(_with_statistics(marked, statistics))
    spark = pairs.sparkSession
    # The sample: the pairs of least hash, of equal ones one.
    closed = ready.filter((F.col("last") == "") & ~F.col("empty") & (F.length("question") > 0)).select("question", "answer", F.xxhash64("question", "answer").alias("h"))
    drawn = closed.select("h").distinct().orderBy("h").limit(sample_rows)
    sample = closed.join(F.broadcast(drawn), "h").dropDuplicates(["h"]).toPandas().sort_values("h", ignore_index=True)
    known = list(damaged(sample))
    # What the corpus knows about the words at which they end.
    asked = spark.createDataFrame([(w,) for w in sorted({_open_word(a) for _, a, *_ in known} - {""})], "word string")
    facts = {r.word: (r.closing, r.inner) for r in _facts(asked, statistics).collect()}
    model = _train(*training_set(known, facts))
    kind = pairs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for i, q, a, e, c in zip(x["id"], x["question"], x["answer"], x["closing"], x["inner"]):
                out += [(i, d) for d in defects(q, a, e, c, model)]
            yield pd.DataFrame(out, columns=["id", "defect"])

    return ready.mapInPandas(judge, "id string, defect string").withColumn("id", F.col("id").cast(kind))
