"""Defects of question-answer pairs, from noisy labelling functions joined by a label model.

For every defect several labelling functions vote yes (1), no (-1) or abstain (0). The
votes of all pairs are counted by pattern, and for each defect an expectation-maximisation
label model (two classes, one vote distribution per function and class, Dirichlet
priors) turns each pattern into a posterior. A pair keeps every label whose posterior
passes its cutoff; `main_defect` picks the one of highest rank among them. Only vote
patterns reach the driver: their number is bounded by the functions, not by the data.

Three groups of functions are learned from the table itself in one pass over all pairs:
how a word is used (does it end clauses, does an article follow it), in which language
it stands (counted in the texts whose function words leave no doubt), and how much more
often it stands in answers that decline by their wording than in other short answers.
They see words no list names. The words that reach the driver hold at least
LEXICON_SHARE of all words each, so there are at most 1 / LEXICON_SHARE of them at any
size of the table; what stays below is judged by that bound.

Defined results: a null response is empty; an answer without question is judged without
it; a null confidence or found abstains; repeated rows give one row per key; ties
between posteriors go by the order of DEFECTS.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulaforge.session import cut

DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
#: Least posteriors of a label. `best_cutoffs` finds them on labelled pairs; the labelled pairs of tests/llm/test_answer_defects.py (400) give these.
CUTOFFS = {"empty": 0.5, "copy": 0.5, "refusal": 0.3, "language": 0.5, "truncated": 0.5}
#: Least share of all words at which a word enters the lexicon: at most 200,000 words.
LEXICON_SHARE = 5e-6
#: Least share at which a word's uses say how it is used. Shares don't change with the size of the table.
USED_SHARE = 25e-6
#: A fragment has at most the first share of the uses of the words it begins, or the second if half of its uses or more are the bare end of an answer.
RARE, RARE_AT_END = 0.01, 0.05
#: An answer of more words isn't a mere refusal.
SHORT = 40
#: Log odds at which learned words decide.
SURE = math.log(20)

# Function words of the languages told apart.
FUNCTION_WORDS = {
    "pt": "o a os as um uma uns umas do da dos das no na nos nas ao à de em com por para que não e ou se é são foi até após sem sob segundo mediante perante desde durante enquanto embora mesmo pelo pela quando porque dado como mais seu sua isso este esta qual quais posso pode devo há antes ainda também apenas sempre".split(),
    "es": "el la los las un una unos unas del al de en con por para que no y o se es son fue hasta después sin bajo según mediante ante desde durante mientras aunque mismo cuando porque como más su sus eso este esta cuál cómo puede puedo debo hay antes aún también solamente siempre ya lo qué".split(),
    "en": "the a an of in on at with by for that not and or is are was until after without under according before from during while although same when because as more its this these which how can may should there only also always given to be does what it has".split(),
    "fr": "le la les un une des du au aux de en avec par pour que ne pas et ou se est sont jusque après sans sous selon devant depuis pendant tandis bien même quand parce comme plus son sa ses ce cette quel quelle peut puis avant aussi seulement toujours chez malgré alors dans qui".split(),
    "de": "der die das ein eine einen dem den des und oder ist sind nicht mit von für auf in im zu zum zur bei nach ohne unter während als auch nur immer wird".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)
ARTICLES = frozenset("o a os as um uma el la los las un una the an given le les une".split())
OPENERS = re.compile(r"(?i)^(?:-\s*)?(?:embora|enquanto|porque|quando|dado que|mesmo que|sempre que|ao passo que|aunque|mientras|cuando|ya que|although|while|because|when|whenever|since|bien que|tandis que|parce que|quand|alors que)\b")
# Wordings of declining: inability or lack of leave with a verb of speaking or helping, or a verb of refusing in the first person.
DECLINE = re.compile(
    r"(?i)\b(?:n[ãa]o\s+(?:posso|consigo|podemos|me\s+é\s+poss[ií]vel|é\s+poss[ií]vel|estou\s+autorizad\w+|estou\s+em\s+condi\w+|devo|tenho\s+permiss\w+)\s+(?:\w+\s+){0,3}?(?:responder|ajudar|aconselhar|falar|dar|fornecer|comentar|discutir|pronunciar\w*|indicar|opinar|prestar|tratar|partilhar)"
    r"|(?:tenho|terei|devo|sou\s+obrigad\w+)\s+(?:de|que|a)?\s*(?:recusar|declinar)|recuso\b|recusar-me|declino\b|abst(?:enho|er)-me|prefiro\s+n[ãa]o\b|sou\s+incapaz"
    r"|no\s+(?:puedo|podemos|me\s+es\s+posible|es\s+posible|estoy\s+autorizad\w+|debo)\s+(?:\w+\s+){0,3}?(?:responder|ayudar\w*|hablar|dar|contestar|comentar|aconsejar|opinar)|(?:debo|tengo\s+que)\s+(?:rechazar|declinar)|rechazo\b|me\s+(?:niego|abstengo)\b|soy\s+incapaz|prefiero\s+no\b"
    r"|(?:i\s*(?:'m|am)?\s*(?:can\s?not|can't|cannot|unable\s+to|not\s+able\s+to|not\s+allowed\s+to|not\s+authori[sz]ed\s+to|won't|(?:must|have\s+to)\s+(?:decline|refuse|abstain)))\b|i\s+(?:decline|refuse)\b|i(?:'d|\s+would)\s+rather\s+not"
    r"|je\s+ne\s+(?:peux|puis)\s+pas\b|il\s+m'est\s+impossible|je\s+(?:dois\s+)?(?:refuser?|décliner?)\b)"
)
LACKS = re.compile(
    r"(?i)(?:n[ãa]o\s+(?:cont[ée]m|menciona\w*|refere\w*|indica\w*|inclui|apresenta|traz|h[áa]\s+(?:refer[êe]ncia|informa\w+|dados|men[çc][ãa]o)|consta\w*|encontr\w+|foi\s+(?:encontrad\w+|poss[íi]vel\s+encontrar)|est[áa]\s+(?:no|na|dispon\w+|presente)|disp\w+\s+de)|nada\s+(?:diz|refere|consta|indica)|informa[çc][ãa]o\s+n[ãa]o\s+(?:encontrada|dispon[íi]vel)|sem\s+informa[çc][ãa]o\b|omiss[oa]\b"
    r"|no\s+(?:contiene|menciona|indica|incluye|consta|figura|se\s+encuentra|hay\s+(?:referencia|informaci[óo]n)|aparece|dispone)|nada\s+dice|informaci[óo]n\s+no\s+(?:encontrada|disponible)"
    r"|(?:does|do|did)\s+not\s+(?:contain|mention|say|state|include|cover|provide|specify)|doesn't\s+(?:contain|mention|say)|not\s+(?:found|mentioned|stated|available|contained|covered)\b|no\s+(?:information|mention|reference)\b|says\s+nothing"
    r"|ne\s+(?:contient|mentionne|pr[ée]cise)\s+pas)"
)
SORRY = re.compile(r"(?i)^\W*(?:lamento|desculp\w*|infelizmente|lo\s+siento|disculp\w*|perd[óo]n|sorry|i'?m\s+sorry|unfortunately|apologies|d[ée]sol[ée]|pe[çc]o\s+desculpa)\b")
FACT = re.compile(r"\d\s*(?:mg|ml|kg|g|%|°|dias|días|days|horas|hours|semanas|semaines|weeks|animais|animales|animals)")
PLACEHOLDER = re.compile(r"(?i)\b(?:n/a|n\.a\.|na|null|none|nil|nan|undefined|vazio|vac[ií]o|empty|tbd|todo|sem\s+(?:resposta|conte[úu]do)|sin\s+respuesta|no\s+answer|resposta|respuesta|answer|response|r[ée]ponse|output|text[oe]?|json)\b")
LABEL = re.compile(r"(?i)^[\W_]*(?:pergunta|quest[ãa]o|pregunta|question|resposta|respuesta|answer|r[ée]ponse|r|p|q|a)\s*(?:\(\w+\))?\s*[:\-–—]+\s*")
_ACCENTS = str.maketrans("áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
_BARE = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*|[.!?;:,](?=\s|$)|\n")
_MARKUP = re.compile(r"<[^>]*>")
_MARKDOWN = re.compile(r"```\w*|\*\*|__|^\s*#+\s")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|‘[^’]*’")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_CLAUSE = re.compile(r"[.!?;:\n]+\s|[;:\n]")
_STRENGTH = re.compile(r"(?<=\s)[A-ZÀ-Ý][\w-]* \d+(?:[.,]\d+)? ?(?:mg|g|ml|%)")
_ELLIPSIS = re.compile(r"\s*(?:\.\.\.+|…+)$")

_BY_WORD: dict[str, list[int]] = defaultdict(list)
for _i, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words:
        _BY_WORD[_w].append(_i)
_BY_WORD = dict(_BY_WORD)


def _plain(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    return _MARKDOWN.sub(" ", text).strip()


def _bare(text: str) -> str:
    """Letters and digits in lower case without accents, single blanks."""
    return " ".join(_BARE.findall(text.lower().translate(_ACCENTS)))


def _words(text: str) -> list[str]:
    """Words and clause marks in order, lower-cased; a word that begins with a digit is `#`."""
    return ["#" if t[0].isdigit() else t for t in _TOKEN.findall(text.lower())]


def _is_word(token: str) -> bool:
    return token[0].isalnum() or token == "#"


def _function_language(tokens: list[str]) -> tuple[int | None, float]:
    """Language of most function words, with its lead over the next as a share."""
    hits = [0] * len(LANGUAGES)
    for t in tokens:
        for i in _BY_WORD.get(t, ()):
            hits[i] += 1
    best = max(range(len(hits)), key=hits.__getitem__)
    rest = max(h for i, h in enumerate(hits) if i != best)
    return (best, (hits[best] - rest) / hits[best]) if hits[best] > rest else (None, 0.0)


_COUNTS = ("total", "ends", "articles", "bare", "declined", "short", *LANGUAGES)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a word: its uses, those right before a clause mark, before an article, as the bare end of an answer, the short answers with it that
    decline or don't, and its uses in texts of a sure language. A number is counted with the word before it. The word "" counts the texts."""
    for batch in batches:
        rows: dict[str, list[int]] = defaultdict(lambda: [0] * len(_COUNTS))
        for question, response in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for text, answer in ((question, False), (response, True)):
                if not text:
                    continue
                plain = _plain(text)
                tokens = _words(plain)
                spoken = [t for t in tokens if t != "#" and _is_word(t)]
                tongue, lead = _function_language(spoken)
                if tongue is not None and lead >= 0.3 and len(spoken) >= 5:
                    for w in spoken:
                        rows[w][6 + tongue] += 1
                    rows[""][6 + tongue] += len(spoken)
                if not answer:
                    continue
                if 1 <= len(spoken) <= SHORT:
                    c = 4 if DECLINE.search(plain) else 5
                    for w in set(spoken):
                        rows[w][c] += 1
                    rows[""][c] += 1
                end = len(tokens) - 1
                for k, t in enumerate(tokens):
                    if not _is_word(t):
                        continue
                    r = rows[f"{tokens[k - 1]} #" if t == "#" and k and _is_word(tokens[k - 1]) else t]
                    r[0] += 1
                    if k == end:
                        r[3] += 1
                    else:
                        r[1] += not _is_word(tokens[k + 1])
                        r[2] += tokens[k + 1] in ARTICLES
        cols = list(zip(*rows.values())) or [()] * len(_COUNTS)
        yield pa.RecordBatch.from_pydict({"w": list(rows)} | dict(zip(_COUNTS, map(list, cols))), schema=_LEXICON)


_LEXICON = pa.schema([("w", pa.string()), *[(c, pa.int64()) for c in _COUNTS]])


class Lexicon:
    """What the words of a table tell. Only ratios of counts decide, so a table and its multiple give the same answers."""

    def __init__(self, rows: list[tuple], total: int):
        """rows: the words of LEXICON_SHARE and more and the row of the word ""; total: all uses of all words."""
        texts = next((r[1:] for r in rows if r[0] == ""), (0,) * len(_COUNTS))
        rows = [r for r in rows if r[0]]
        used, self.unknown = USED_SHARE * total, LEXICON_SHARE * total
        self.uses = {r[0]: (r[1], r[4]) for r in rows}
        self.verbs, self.never, self.endings = set(), set(), set()
        longer: Counter[str] = Counter()
        for w, n, ends, articles, bare, *_ in rows:
            if n < used or not n:
                continue
            inner = n - bare
            if inner and (ends + 0.5) / (inner + 1) < 0.01:
                self.never.add(w)
            if inner and ends / inner >= 0.015:
                self.endings.add(w)
            if inner and articles / inner >= 0.6 and ends / inner < 0.03 and w not in _BY_WORD:
                self.verbs.add(w)
            if " " not in w:
                for k in range(1, len(w)):
                    longer[w[:k]] += n
        self.longer = dict(longer)
        # Log odds of declining, and log probabilities of the languages, by word.
        yes, no = texts[4], texts[5]
        self.declining = {r[0]: math.log((r[5] + 0.1) / (yes + 0.2)) - math.log((r[6] + 0.1) / (no + 0.2)) for r in rows if yes and no and r[5] + r[6]}
        sizes = texts[6:]
        self.tongues = {}
        for r in rows:
            if sum(r[7:]):
                logs = [math.log((n + 0.1) / (s + 1.0)) if s else -30.0 for n, s in zip(r[7:], sizes)]
                self.tongues[r[0]] = logs

    def is_fragment(self, w: str) -> bool:
        n, bare = self.uses.get(w, (self.unknown, 0))
        return w in self.longer and n <= (RARE_AT_END if 2 * bare >= n else RARE) * self.longer[w]

    def declines(self, words: set[str]) -> float:
        """Log odds that an answer of these words declines. Only words that favour it count: answers whose wording no list names stand among the others."""
        return sum(x for x in (self.declining.get(w, 0.0) for w in words) if x > 0)

    def language(self, words: list[str]) -> int | None:
        """The language of the words, if the learned words are sure of it."""
        sums = [0.0] * len(LANGUAGES)
        for w in words:
            logs = self.tongues.get(w)
            if logs:
                for i, x in enumerate(logs):
                    sums[i] += x
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        return order[0] if sums[order[0]] - sums[order[1]] >= SURE else None


def count_lexicon(pairs: DataFrame) -> Lexicon:
    """pairs(question, response). At most 1 / LEXICON_SHARE words reach the driver, whatever the size of the table."""
    counted = cut(pairs.mapInArrow(_count_words, "w string, " + ", ".join(f"{c} bigint" for c in _COUNTS)).groupBy("w").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    total = counted.agg(F.sum("total")).first()[0] or 0
    rows = counted.where((F.col("total") >= LEXICON_SHARE * total) | (F.col("w") == "")).collect()
    return Lexicon([tuple(r) for r in rows], total)


#: The labelling functions of each defect; how likely a vote that is cast is first taken to be a yes, for a defective and for another pair.
FUNCTIONS: dict[str, list[tuple[str, float, float]]] = {
    "empty": [("no letter", 0.98, 0.001), ("only placeholders", 0.98, 0.001), ("few words", 0.98, 0.01), ("low confidence", 0.7, 0.2)],
    "copy": [("same letters", 0.98, 0.002), ("same words", 0.98, 0.01), ("near words", 0.98, 0.01)],
    "refusal": [("declining words", 0.98, 0.002), ("lacks though found", 0.98, 0.002), ("opening", 0.9, 0.05), ("learned words", 0.95, 0.01), ("no facts", 0.98, 0.3), ("low confidence", 0.6, 0.3)],
    "language": [("function words", 0.98, 0.002), ("learned words", 0.98, 0.002), ("sentences", 0.98, 0.01)],
    "truncated": [("dangling mark", 0.9, 0.005), ("open bracket", 0.9, 0.005), ("ellipsis", 0.9, 0.005), ("never ends", 0.9, 0.005), ("fragment", 0.9, 0.005), ("half a sentence", 0.7, 0.005)],
}


def votes(question: str | None, response: str | None, found: bool | None, confidence: float | None, lexicon: Lexicon) -> dict[str, list[int]]:
    """The votes of all labelling functions, by defect, in the order of FUNCTIONS."""
    response = response or ""
    plain = _plain(response)
    tokens = _words(plain)
    words = [t for t in tokens if _is_word(t)]
    content = PLACEHOLDER.sub(" ", re.sub(r"\"\w+\"\s*:", " ", plain)) if len(plain) < 200 else plain
    blank = not _BARE.search(content)
    nothing = not _BARE.search(plain)
    sure = None if confidence is None else confidence / 100 if confidence > 1 else confidence
    low = 0 if sure is None else 1 if sure < 0.45 else -1 if sure > 0.7 else 0
    out: dict[str, list[int]] = {"empty": [1 if nothing else 0 if blank else -1, 1 if blank else -1, 1 if len(words) <= 1 and len(response) < 60 else -1 if len(words) >= 3 else 0, low]}

    asked = _bare(question or "")
    copied = False
    if not asked or blank:
        out["copy"] = [-1 if asked else 0, 0, 0]
    elif len(response) > 4 * len(question or "") + 60:
        out["copy"] = [-1, -1, -1]
    else:
        said = _bare(LABEL.sub("", plain))
        own_asked = _bare(LABEL.sub("", question or ""))
        again = said in {asked, own_asked, f"{asked} {asked}", f"{asked} {asked} {asked}", f"{own_asked} {own_asked}"}
        own, theirs = set(said.split()), set(asked.split())
        near = len(own & theirs) / max(1, len(own | theirs))
        same = own <= theirs and len(own) >= 0.8 * len(theirs)
        out["copy"] = [1 if again else -1, 1 if same else -1 if near < 0.7 else 0, 1 if near >= 0.85 and len(said) <= 2.2 * len(asked) else -1 if near < 0.7 else 0]
        copied = again

    if blank or copied:
        out["refusal"] = [-1, 0, 0, -1, 0, 0]
    elif len(words) > SHORT:
        # Only a short answer is a mere refusal.
        out["refusal"] = [-1, -1, -1, -1, -1, low]
    else:
        lacks = LACKS.search(plain) is not None
        odds = lexicon.declines(set(words))
        learned = 1 if odds >= 3 * SURE else -1 if odds < SURE else 0
        facts = -1 if FACT.search(_STRENGTH.sub(" ", plain)) else 0
        out["refusal"] = [
            1 if DECLINE.search(plain) else 0 if learned > 0 or lacks else -1,
            1 if lacks and found is True else -1 if lacks else 0,
            1 if SORRY.search(plain) else 0,
            0 if lacks else learned,
            facts,
            low,
        ]

    out["language"] = [-1, 0, 0] if copied or blank else _language_votes(question or "", plain, lexicon)
    out["truncated"] = [-1] * 6 if copied or blank else _truncation_votes(plain, tokens, lexicon)
    return out


def _language_votes(question: str, plain: str, lexicon: Lexicon) -> list[int]:
    spoken = _QUOTED.sub(" ", plain) if any(q in plain for q in "\"“«‘") else plain
    said = [[t for t in _TOKEN.findall(s) if t[0].isalpha()] for s in _SENTENCE.split(spoken.lower())]
    words = [w for s in said for w in s]
    asked = [t for t in _TOKEN.findall(question.lower()) if t[0].isalpha()]
    if len(words) < 5 or not asked:
        return [0, 0, 0]
    learned_q = lexicon.language(asked)
    listed_q, lead_q = _function_language(asked)
    q = learned_q if learned_q is not None else listed_q
    if q is None:
        return [0, 0, 0]
    listed, lead = _function_language(words)
    learned = lexicon.language(words)
    tongues = [t for t in (lexicon.language(s) for s in said if len(s) >= 4) if t is not None]
    away = sum(t != q for t in tongues) / len(tongues) if tongues else 0.5
    return [
        0 if listed is None or lead < 0.15 else 1 if listed != q else -1,
        0 if learned is None else 1 if learned != q else -1,
        0 if not tongues else 1 if away >= 0.75 else -1 if away <= 0.4 else 0,
    ]


def _truncation_votes(plain: str, tokens: list[str], lexicon: Lexicon) -> list[int]:
    text = plain.rstrip()
    cut_text = _ELLIPSIS.sub("", text)
    ellipsis = cut_text != text and cut_text[-1:].isalnum()
    if cut_text != text:
        tokens = _words(cut_text)
    words = [t for t in tokens if _is_word(t)]
    if len(words) < 3:
        return [0, 0, 0, 0, 0, 0]
    opened = cut_text.count('"') % 2 == 1 or cut_text.count("“") > cut_text.count("”") or cut_text.count("«") > cut_text.count("»") or cut_text.count("(") > cut_text.count(")")
    if re.search(r"[.!?][\"”»')\]]*$", cut_text) and not ellipsis:
        # A mark inside an open bracket or quotation doesn't end it.
        return [0, 1, 0, 0, 0, 0] if opened else [-1] * 6
    dangling = re.search(r"[,;:\-–—(\[/&]$", cut_text) is not None
    never = fragment = half = 0
    if cut_text[-1].isalnum():
        last = tokens[-1]
        key = f"{tokens[-2]} #" if last == "#" and len(tokens) > 1 else last
        never = 1 if key in lexicon.never or (last in _BY_WORD and key not in lexicon.endings) else -1 if key in lexicon.endings else 0
        fragment = 0 if last == "#" else 1 if lexicon.is_fragment(last) else -1 if never < 0 else 0
        clause = _words(_CLAUSE.split(cut_text)[-1])
        inner = [t for t in clause if _is_word(t)]
        sentence = re.split(r"(?<=[.!?;])\s+|\n", cut_text)[-1]
        opener = OPENERS.search(sentence) is not None and "," not in sentence and len(inner) < 16
        bodiless = len(inner) >= 2 and not any(w in lexicon.verbs for w in inner) and len(words) > len(inner) + 5
        half = 1 if opener or bodiless else -1 if never < 0 else 0
    ended = [never, fragment, half]
    if opened or ellipsis:
        # No word ends an open bracket or quotation, nor what an ellipsis goes on.
        ended = [max(0, x) for x in ended]
    return [1 if dangling else 0, 1 if opened else 0, 1 if ellipsis else 0, *ended]


def _vote_batches(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        patterns = []
        for q, r, f, c in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
            v = votes(q, r, f, c, lexicon)
            patterns.append("|".join(",".join(map(str, v[d])) for d in DEFECTS))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(patterns, pa.string())], names=["id", "votes"])


def label_model(patterns: list[tuple[tuple[int, ...], int]], first: list[tuple[str, float, float]], rounds: int = 100, mass: tuple[float, float] = (0.02, 0.3)) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for each vote pattern, by expectation maximisation over (pattern, count). Abstentions say nothing of either class.
    first: the shares of yes it starts from; they also serve as priors, of the mass of so many times the pairs. Where one function alone speaks for a defect,
    nothing but the prior of the other pairs tells its errors from its hits."""
    v = np.array([p for p, _ in patterns], int)
    n = np.array([c for _, c in patterns], float)
    yes_votes, no_votes = (v == 1).astype(float), (v == -1).astype(float)
    start = np.array([[p, q] for _, p, q in first])
    weight, share, rates, post = np.array(mass) * n.sum(), 0.03, start, np.zeros(len(n))
    for _ in range(rounds):
        a, b = (yes_votes @ np.log(rates[:, k]) + no_votes @ np.log(1 - rates[:, k]) for k in (0, 1))
        new = 1 / (1 + np.exp(np.clip(b - a + math.log((1 - share) / share), -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
        by = np.stack([n * post, n * (1 - post)], axis=1)
        rates = np.clip((yes_votes.T @ by + start * weight) / ((yes_votes + no_votes).T @ by + weight), 1e-6, 1 - 1e-6)
        share = float(np.clip((n * post).sum() / n.sum(), 1e-3, 0.5))
    return {p: float(x) for (p, _), x in zip(patterns, post)}


def _columns(pairs: DataFrame) -> DataFrame:
    confidence = F.col("confidence").cast("double") if "confidence" in pairs.columns else F.lit(None).cast("double")
    return pairs.select("id", "question", "response", "found", confidence.alias("confidence"))


def defect_posteriors(pairs: DataFrame) -> tuple[DataFrame, list[tuple[str, str, float]]]:
    """The pairs' vote patterns (id, votes) and, of the patterns that occur, (votes, defect, posterior)."""
    spark = pairs.sparkSession
    rows = _columns(pairs)
    lexicon = spark.sparkContext.broadcast(count_lexicon(rows.select("question", "response")))
    kind = rows.schema["id"].dataType.simpleString()
    voted = cut(rows.mapInArrow(lambda it: _vote_batches(it, lexicon.value), f"id {kind}, votes string"))
    # At most 3**22 vote patterns exist, and a few hundred occur.
    counts = [(r["votes"], [tuple(map(int, x.split(","))) for x in r["votes"].split("|")], r["count"]) for r in voted.groupBy("votes").count().collect()]
    table: list[tuple[str, str, float]] = []
    for d, defect in enumerate(DEFECTS):
        own: Counter[tuple[int, ...]] = Counter()
        for _, pattern, n in counts:
            own[pattern[d]] += n
        if own:
            posterior = label_model(sorted(own.items()), FUNCTIONS[defect])
            table += [(text, defect, posterior[pattern[d]]) for text, pattern, _ in counts]
    return voted, table


def defect_labels(pairs: DataFrame, cutoffs: dict[str, float] = CUTOFFS) -> DataFrame:
    """pairs(id, question, response, found[, confidence]) → (id, defect, posterior): every label that passes its cutoff."""
    voted, table = defect_posteriors(pairs)
    passed = [x for x in table if x[2] >= cutoffs[x[1]]]
    labels = pairs.sparkSession.createDataFrame(passed, "votes string, defect string, posterior double")
    return voted.join(F.broadcast(labels), "votes").select("id", "defect", "posterior")


def best_cutoffs(scored: list[tuple[str, float, bool]]) -> dict[str, float]:
    """Of the cutoffs 0.1, 0.2 … 0.9 the one nearest to 0.5 that has the best F1 for each defect. scored: (defect, posterior, truly so)."""
    out = {}
    for d in DEFECTS:
        own = [(p, t) for defect, p, t in scored if defect == d]

        def f1(cutoff: float) -> float:
            hit = sum(t for p, t in own if p >= cutoff)
            return 2 * hit / max(1, sum(p >= cutoff for p, _ in own) + sum(t for _, t in own))

        out[d] = min((c / 10 for c in range(1, 10)), key=lambda c: (-f1(c), abs(c - 0.5)))
    return out


def main_defect(labels: DataFrame) -> DataFrame:
    """(id, defect): of several labels the one that comes first in DEFECTS."""
    rank = F.coalesce(*[F.when(F.col("defect") == d, F.lit(k)) for k, d in enumerate(DEFECTS)])
    return labels.groupBy("id").agg(F.min_by("defect", rank).alias("defect"))
