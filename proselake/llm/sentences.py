"""Sentence boundaries by a hidden-event n-gram model.

Between any two tokens stands a hidden event: a boundary or none. The model is learned from the texts themselves: a
blank line is a certain boundary, a token inside a run of words a certain none. Counted over all texts are, for each
token that ends in a period, how often it stands at all and before a blank line; for each token how often it stands at
all, follows a boundary and stands before one (tokens of scripts without spaces are pairs of characters). If boundaries
are blank lines with the rate r, a token seen N times that ends sentences with probability e stands before a blank line
e r N times, which gives e, smoothed by a prior from its shape. The odds of a boundary between two tokens are those of
the event times the n-gram ratios of the tokens beside it: the following token's probabilities after a boundary and
inside a sentence and, where no mark stands, the preceding token's before a boundary and inside.

Candidates are the marks that may end a sentence; in a paragraph without any, every gap between tokens, with the rate
of boundaries a token as the event's own odds. Forward and backward passes over the candidates of a paragraph give
posteriors, with a factor against sentences without words; a posterior of half or more is a boundary. Signs that leave
no choice (blank lines, a lower-case word or a comma after a closing quote, a reporting clause, Thai spaces) are certain
events of the same chain.

The counts are exact for every token. The VOCABULARY most frequent tokens of each table go to every task; where there
are more, each text gets the counts of its rarer tokens by a join.
"""

from __future__ import annotations

import copy
import re
import unicodedata
from bisect import bisect_left
from collections import ChainMap, Counter
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselake.llm.repetition import UNSPACED
from proselake.session import materialize

#: Tokens of each table of the model that tasks hold in memory; the others' counts are joined to the texts that need them.
VOCABULARY = 50_000
MORE = "array<struct<part:string,token:string,n:bigint>>"
#: Occurrences that the prior of a token's shape counts for.
PRIOR_WEIGHT = 12.0
# Abbreviations whose prior is not to end a sentence (lower case, without the last period).
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof st mt lt col gen capt sgt rev hon gov sen rep pres messrs mme mlle mgr no nos vol vols pp p fig figs ch sec art ed eds cf vs viz al e.g i.e "
    "ave blvd rd dept est approx ca bzw z.b d.h u.a usw nr hr fr str bd hrsg geb sog evtl ggf inkl zzgl abs aufl ff s m mm env av ex h éd "
    "sr sra srta dña d ud uds vds núm pág págs aprox tel izq dcha c ee.uu г гг в вв т тт стр с ул пр д кв им см ср др пр тыс млн млрд руб коп акад проф "
    "т.е т.д т.п т.к डॉ श्री पृ सं ई د أ م ص ج هـ jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
# Verbs of reporting clauses, by language.
REPORTING = frozenset(
    "said asked cried replied answered whispered muttered added shouted called murmured exclaimed continued began went remarked observed declared announced "
    "repeated yelled screamed sighed laughed snapped demanded insisted explained told wondered says asks cries replies answers whispers "
    "sagte fragte rief antwortete flüsterte schrie meinte erwiderte murmelte dit demanda cria répondit murmura ajouta s'écria chuchota "
    "dijo preguntó gritó respondió susurró murmuró exclamó añadió contestó сказал сказала спросил спросила крикнул крикнула ответил ответила прошептал прошептала "
    "سأل سألت قال قالت صاح صاحت همس همست أجاب أجابت رد ردت هتف هتفت نادى نادت पूछा कहा बोला बोली चिल्लाया चिल्लाई पुकारा फुसफुसाया".split()
)
REPORTING_ZH = re.compile(r"[^\s，。！？：“”、；]{1,6}?(?:低声|大声|轻声|小声)?(?:问道|说道|喊道|叫道|答道|回答|问|说|喊|叫|答|道|嚷)(?!：|:|“)")
REPORTING_JA = re.compile(r"(?:と|って)|[^\s、。！？「」]{1,10}?(?:は|が)[^、。！？「」]{0,8}?(?:叫|言|尋|聞|答|呼|囁|ささや|つぶや|呟|訊)")
ENDS = ".!?…。！？।؟．｡॥‽"
CLOSERS = "\"'”’»)]}」』）】〉》›“‘"
#: Closing marks whatever follows them; straight quotes and “ close only before a space or a mark.
SURE_CLOSERS = "”’»)]}」』）】〉》›"
OPENERS = "\"'“‘«‹([{「『（【〈《¿¡„‚—–-"
#: A candidate: marks that may end a sentence, with the closing marks that follow.
MARKS = re.compile(rf"[{re.escape(ENDS)}]+(?:[{re.escape(SURE_CLOSERS)}]+|[\"'“‘](?=[\s,.;:)\]]|$)|[ \u00a0\u2009\u202f]+[»›])*")
BLANK = re.compile(r"\n[^\S\n]*\n")
WIDE = {0xFF01 + i: 0x21 + i for i in range(94)}
HARD = set("。！？।؟॥｡")
UNSPACED_END = re.compile(r"[。！？!?…．｡\n]+[」』”’）)]*")
THAI = re.compile("[฀-๿]")
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"\S+")
_EDGES = frozenset(CLOSERS + OPENERS + ",;:" + ENDS)
WORD_OR_MARK = re.compile(r"[^\s.!?।؟,;:]+|[.!?।؟,;:]")
#: Words and marks after a quotation among which its reporting verb stands.
CLAUSE = 7
#: Opening marks by what closes them.
OPENED_BY = {"”": "“", "’": "‘", "»": "«", "」": "「", "』": "『", "“": "„", '"': '"', "'": "'", "›": "‹"}
KEEP_WIDE = {ord(c): None for c in "！？（）"}


def _shape(token: str) -> str:
    """The class of a token: digits as 0, an initial as one."""
    t = token.lower()
    if len(token) == 1 and token.isupper():
        return "<initial>"
    return re.sub(r"\d+", "0", t)


def _core(token: str) -> str:
    return token.strip(CLOSERS + OPENERS + ",;:" + ENDS)


def prior(token: str, raw: str) -> float:
    """How likely a token before a period ends a sentence, from its shape."""
    if token in ABBREVIATIONS:
        return 0.02
    if token == "<initial>":
        return 0.02
    if "." in token:
        return 0.35
    if not any(c.isalpha() for c in token):
        return 0.6
    letters = sum(c.isalpha() for c in token)
    if letters == 1:
        return 0.15
    return 0.97 if letters >= 4 else 0.9


def unspaced(p: str) -> bool:
    """Whether most letters of a paragraph belong to scripts without spaces."""
    return not p.isascii() and 2 * len(UNSPACED.findall(p)) > sum(map(str.isalpha, p))


def count_texts(texts: list[str | None]) -> Counter:
    """The model's counts, of (table, token).

    all and start: tokens, and those after a boundary, as they are written (those with a capital, as no others are
    asked for). any, first, last, capital: tokens in lower case, those after and before a boundary, those before a capital
    inside a sentence. dot and stop: tokens
    before a period, and before a period and a blank line. sum: starts, tokens; dot and stop of whole words.
    """
    n: Counter = Counter()
    everything: Counter = Counter()
    starts: Counter = Counter()
    lasts: Counter = Counter()
    before: Counter = Counter()
    for t in texts:
        if not t:
            continue
        for p in BLANK.split(t.replace("\r", "")):
            tokens = p.split()
            if not tokens:
                continue
            if unspaced(p):
                for s in UNSPACED_END.split(p):
                    if len(s := _core(SPACE.sub("", s))) >= 2:
                        n.update(("any", s[i : i + 2]) for i in range(len(s) - 1))
                        n["first", s[:2]] += 1
                        n["last", s[-2:]] += 1
                        n["sum", "pairs"] += len(s) - 1
                        n["sum", "pieces"] += 1
                continue
            everything.update(tokens)
            starts[tokens[0]] += 1
            last = len(tokens) - 1
            for i, w in enumerate(tokens):
                end = w[-1]
                if i < last and tokens[i + 1][0].isupper() and end.isalnum():
                    before[w] += 1
                if end == "." or end in CLOSERS and "." in w[-3:]:
                    w = w.rstrip(CLOSERS)
                    if not w or w[-1] != "." or w.endswith(".."):
                        continue
                    k = _shape(_core(w))
                    whole = k not in ABBREVIATIONS and "." not in k and sum(map(str.isalpha, k)) >= 4
                    if whole:
                        lasts[w] += 1
                    for part in ("dot", "stop") if i == last else ("dot",):
                        n[part, k] += 1
                        n["sum", part] += whole
                elif end in "!?":
                    lasts[w] += 1
                    if i < last:
                        starts[tokens[i + 1]] += 1
    for part, fold, table in (("all", "any", everything), ("start", "first", starts), (None, "last", lasts), (None, "capital", before)):
        for w, c in table.items():
            if k := _core(w):
                if part and k[0].isupper():
                    n[part, k] += c
                n[fold, k.lower()] += c
    n["sum", "tokens"] += sum(everything.values())
    n["sum", "starts"] += sum(starts.values())
    n["sum", "lasts"] += sum(lasts.values())
    n["sum", "capitals"] += sum(before.values())
    return n


class Model:
    """Counts by (table, token). rest: (part, token, n) of the tokens that counts lacks; None if it lacks none."""

    def __init__(self, counts: dict[tuple[str, str], int], rest: DataFrame | None = None) -> None:
        self.counts, self.rest = counts, rest
        self.starts = counts.get(("sum", "starts"), 0) + 1.0
        self.tokens = counts.get(("sum", "tokens"), 0) + 1.0
        self.lasts = counts.get(("sum", "lasts"), 0) + 1.0
        self.capitals = counts.get(("sum", "capitals"), 0) + 1.0
        self.pairs, self.pieces = counts.get(("sum", "pairs"), 0) + 1.0, counts.get(("sum", "pieces"), 0) + 1.0
        self.rate = min(0.9, max(0.02, (counts.get(("sum", "stop"), 0) + 1) / (counts.get(("sum", "dot"), 0) + 5)))

    def of(self, part: str, token: str) -> int:
        return self.counts.get((part, token), 0)

    def held(self) -> Model:
        """The model without the table of the rest, for tasks."""
        m = copy.copy(self)
        m.rest = None
        return m

    def plus(self, more: dict[tuple[str, str], int]) -> Model:
        """The model of a text, with the counts of its tokens that this one lacks."""
        m = copy.copy(self)
        m.counts = ChainMap(more, self.counts)
        return m

    def ends(self, raw: str) -> float:
        """Probability that a token with a period ends a sentence."""
        k = _shape(raw)
        n, s = self.of("dot", k), self.of("stop", k)
        e = (s + PRIOR_WEIGHT * prior(k, raw) * self.rate) / ((n + PRIOR_WEIGHT) * self.rate)
        return min(0.995, max(0.005, e))

    def follows(self, word: str) -> float:
        """Ratio of a token's probability after a boundary and inside a sentence."""
        s, a = self.of("start", word), self.of("all", word)
        inside = max(0.0, a - s / max(self.rate, 0.05))
        r = ((s + 0.5) / self.starts) / ((inside + 0.5) / self.tokens)
        return min(200.0, max(0.05, r))


    def _ratio(self, part: str, token: str, here: float, everywhere: float) -> float:
        """Ratio of a token's probability beside a boundary and anywhere, in lower case; 1 for a token never seen."""
        return min(50.0, max(0.02, (self.of(part, token) + 0.5) / here / ((self.of("any", token) + 0.5 * everywhere / here) / everywhere)))

    def gap(self, left: str, right: str, cased: bool) -> float:
        """Probability of a boundary between two words without a mark. cased: the text has capitals, so that a sentence begins with one."""
        odds = min(0.5, self.starts / self.tokens) * self._ratio("last", left.lower(), self.lasts, self.tokens)
        if not cased:
            odds *= self._ratio("first", right.lower(), self.starts, self.tokens)
        else:
            # n-gram of the left token and the class of the right one: how often a capital follows it inside a sentence
            odds *= self.follows(right) / self._ratio("capital", left.lower(), self.capitals, self.tokens) if right[:1].isupper() else 0.001
        return odds / (1 + odds)

    def pair_gap(self, left: str, right: str) -> float:
        """Probability of a boundary between two pairs of characters of a script without spaces."""
        odds = min(0.5, self.pieces / self.pairs) * self._ratio("last", left, self.pieces, self.pairs) * self._ratio("first", right, self.pieces, self.pairs)
        return odds / (1 + odds)


class Asked(Model):
    """Keeps what a text asks of a model that the model lacks; what is asked doesn't depend on the answers."""

    def __init__(self, model: Model) -> None:
        self.__dict__.update(model.__dict__)
        self.lacks: set[tuple[str, str]] = set()

    def of(self, part: str, token: str) -> int:
        if (part, token) not in self.counts:
            self.lacks.add((part, token))
        return super().of(part, token)


def _simple(text: str) -> tuple[str, list[int] | None]:
    """The text with full-width forms as plain ones and invisible characters gone, and the place of each of its characters (None: the same)."""
    plain = text.translate({k: v for k, v in WIDE.items() if k not in KEEP_WIDE}) if any("！" <= c <= "～" for c in text) else text
    if plain.isascii() or not any(unicodedata.category(c) == "Cf" for c in set(plain)):
        return plain, None
    at = [i for i, c in enumerate(plain) if unicodedata.category(c) != "Cf"]
    return "".join(plain[i] for i in at), at


class Paragraph:
    """A paragraph with the places of its spaces, line ends and opening marks."""

    def __init__(self, p: str) -> None:
        self.p = p
        self.spaces = [m.end() for m in SPACE.finditer(p)]
        self.lines = [i + 1 for i, c in enumerate(p) if c == "\n"] if "\n" in p else []
        self.opened: dict[str, list[int]] = {}

    @staticmethod
    def _last(places: list[int], at: int) -> int | None:
        i = bisect_left(places, at)
        return places[i - 1] if i else None

    def token_start(self, at: int) -> int:
        return self._last(self.spaces, at + 1) or 0

    def line_start(self, at: int) -> int:
        return self._last(self.lines, at + 1) or 0

    def quote_start(self, end: int) -> int:
        """Where the quotation that closes before end opens (end if unknown)."""
        opening = OPENED_BY.get(self.p[end - 1])
        if opening is None:
            return end
        if opening not in self.opened:
            self.opened[opening] = [i for i, c in enumerate(self.p) if c == opening]
        at = self._last(self.opened[opening], end - 1)
        return end if at is None else at

    def reported(self, end: int, bare: int) -> bool:
        """Whether what begins at bare reports the quotation that closes before end."""
        at = self.quote_start(end) - 1
        while at >= 0 and self.p[at].isspace():
            at -= 1
        if at >= 0 and self.p[at] in ":：":
            return False  # the quote was announced before
        if REPORTING_ZH.match(self.p, bare) or REPORTING_JA.match(self.p, bare):
            return True
        words = [m.group(0) for m in islice(WORD_OR_MARK.finditer(self.p, bare), CLAUSE)]
        verb = next((i for i, w in enumerate(words) if w.lower() in REPORTING), None)
        if verb is None:
            return False
        lead = words[:verb]
        if any(w in ".!?।؟;:," and (i == 0 or lead[i - 1].lower() not in ABBREVIATIONS) for i, w in enumerate(lead)):
            return False
        # names, titles and pronouns may stand between; in scripts without capitals up to four words
        return len(lead) <= 4 and all(w in "." or not w[0].islower() or w in ("the", "old", "he", "she", "they", "i", "von", "de", "der", "la", "le", "ने", "से") for w in lead)


def paragraph_ends(p: str, model: Model, thai: bool) -> list[int]:
    """Ends of the sentences of one paragraph, without its own end."""
    found: list[tuple[int, float]] = []
    q, n, marked = Paragraph(p), len(p), False
    dirty = -1  # start of the last token that holds a word before a mark inside it
    for m in MARKS.finditer(p):
        marked = True
        end, marks = m.end(), m.group(0)
        bare = end
        while bare < n and p[bare].isspace():
            bare += 1
        if bare == n:
            continue
        gap = bare - end
        start = q.token_start(m.start())
        inner, dirty = dirty == start, start if dirty == start or any(map(str.isalnum, p[start : m.start()])) else dirty
        nxt = bare
        while nxt < n and p[nxt] in OPENERS + "   ":
            nxt += 1
        nxt = p[nxt : nxt + 1]
        quoted = marks[-1] in "\"'”’»」』“›" and marks[-1] not in ENDS
        core = marks.rstrip(CLOSERS + "    ")
        hard = any(c in HARD for c in core)
        if p[bare] in ",;:，、；：)）" or p[bare] in CLOSERS and p[bare] not in OPENERS:
            continue
        if "…" in core or ".." in core:
            # only before a capital letter
            if nxt.isupper() and (gap or quoted) and not (quoted and q.reported(end, bare)):
                found.append((end, _times(0.98, _follow(p, bare, model))))
            continue
        if nxt and nxt.islower():
            continue  # also a dash before a reporting clause
        if quoted and q.reported(end, bare):
            continue
        if hard or core[-1] in "!?":
            if not gap and not hard and not quoted and not (nxt.isupper() and core[-1] in "!?"):
                if nxt.isalnum() and nxt.isascii():
                    continue
            found.append((end, _times(0.99, _follow(p, bare, model))))
            continue
        # periods: the model decides
        if not gap and not quoted:
            # a forgotten space: a word in lower case, a period, a capitalised word
            word = "" if inner else _core(p[start : m.start()])
            if not (len(word) >= 3 and word.isalpha() and word[1:].islower() and re.match(r"[^\W\d_]{2}|[“\"‘«(]", p[bare : bare + 2]) and p[bare].isupper() and not p[bare + 1 : bare + 2].isupper()):
                continue
        word = _core(p[start : m.start()])
        if not word and not quoted:
            continue
        if word.isdigit() and len(word) <= 4 and not p[q.line_start(m.start()) : start].strip():
            continue  # the number of a list
        e = model.ends(word) if word else 0.9
        if quoted or marks[-1] in ")]）":
            e = max(e, 0.5)
        if word.isdigit():
            e = min(e, 0.5)  # ordinals and list numbers share the class of numbers
        follow = _follow(p, bare, model)
        found.append((end, _times(e, follow if follow != 1.0 else 0.02 if nxt.isdigit() else 1.0)))
    if thai:
        for m in re.finditer(r"\s+", p):
            a, b = p[m.start() - 1 : m.start()], p[m.end() : m.end() + 1]
            if not a or not b or "\n" not in m.group(0) and (a.isdigit() or b.isdigit()):
                continue
            found.append((m.start(), 1.0))
        found = sorted(dict(found).items())
    elif not marked:
        found = gaps(p, model)
    return [end for (end, _), post in zip(found, posteriors(p, found)) if post >= 0.5]


def _follow(p: str, bare: int, model: Model) -> float:
    """The model's ratio for the token that begins at bare; 1 for one without a capital."""
    at = bare
    while at < len(p) and p[at] in _EDGES:
        at += 1
    if not p[at : at + 1].isupper():
        return 1.0
    return model.follows(_core(TOKEN.match(p, at).group(0)))


def _times(p: float, ratio: float) -> float:
    odds = p / (1 - p) * ratio
    return odds / (1 + odds)


def gaps(p: str, model: Model) -> list[tuple[int, float]]:
    """The hidden events between the tokens of a paragraph without marks, with their probabilities."""
    if unspaced(p):
        places = [i for i, c in enumerate(p) if not c.isspace()]
        s = "".join(p[i] for i in places)
        return [(places[i - 1] + 1, model.pair_gap(s[i - 2 : i], s[i : i + 2])) for i in range(2, len(s) - 1)]
    tokens = [(m.group(0), m.end()) for m in re.finditer(r"\S+", p)]
    # where most words have capitals, or none has, these tell nothing
    cased = 0 < 2 * sum(_core(w)[:1].isupper() for w, _ in tokens) < len(tokens)
    out = []
    for (left, end), (right, _) in zip(tokens, tokens[1:]):
        a, b = _core(left), _core(right)
        # none after a token with a mark at its end, and none inside a reporting clause
        out.append((end, model.gap(a, b, cased) if a and b and left[-1].isalnum() and a.lower() not in REPORTING and right[0] not in ",;:)" else 0.0))
    return out


def posteriors(p: str, found: list[tuple[int, float]]) -> list[float]:
    """Forward-backward over the candidates of a paragraph: the events' posteriors, with a factor against sentences without words."""
    if not found:
        return []
    probs = [min(1 - 1e-9, max(1e-9, x)) for _, x in found]
    empty = [not any(c.isalnum() for c in p[a:b]) for a, b in zip([0, *(e for e, _ in found)], (e for e, _ in found))]
    fwd: list[tuple[float, float]] = []
    n0, n1 = 0.0, 1.0  # the paragraph begins after a boundary
    for x, hollow in zip(probs, empty):
        penalty = 0.02 if hollow else 1.0
        a0, a1 = (n0 + n1) * (1 - x), (n0 + n1 * penalty) * x
        s = a0 + a1
        n0, n1 = a0 / s, a1 / s
        fwd.append((n0, n1))
    out, b0, b1 = [0.0] * len(probs), 1.0, 1.0
    for i in range(len(probs) - 1, -1, -1):
        f0, f1 = fwd[i]
        out[i] = f1 * b1 / (f0 * b0 + f1 * b1)
        x, penalty = probs[i], 0.02 if empty[i] else 1.0
        c0, c1 = (1 - x) * b0 + x * b1, (1 - x) * b0 + x * penalty * b1
        s = c0 + c1
        b0, b1 = c0 / s, c1 / s
    return out


def sentence_ends(text: str | None, model: Model) -> list[int]:
    """The end of each sentence in code points from the start of the text; of null, empty and blank texts none."""
    if not text or not text.strip():
        return []
    plain, at = _simple(text.replace("\r\n", " \n"))
    letters = sum(map(str.isalpha, plain))
    thai = letters > 0 and 2 * len(THAI.findall(plain)) > letters
    ends, a = [], 0
    for b in [*((m.start(), m.end()) for m in BLANK.finditer(plain)), (len(plain), len(plain))]:
        p = plain[a : b[0]]
        if p.strip():
            lead = len(p) - len(p.lstrip())
            ends += [a + lead + e for e in paragraph_ends(p.strip(), model, thai)]
            ends.append(a + len(p.rstrip()))
        a = b[1]
    return sorted({(at[e - 1] + 1 if at else e) for e in ends})


def learn(documents: DataFrame) -> Model:
    """The model from all texts given. Collected: at most VOCABULARY tokens of each of four tables; the others stay a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            n.update(count_texts(b.column(0).to_pylist()))
            if len(n) > 500_000:
                yield _rows(n)
                n = Counter()
        yield _rows(n)

    counts = documents.select("text").mapInArrow(run, "part string, token string, n bigint").groupBy("part", "token").agg(F.sum("n").alias("n"))
    counts = materialize(counts)
    # how many tokens have counts of each size gives the least count to collect, without sorting any table
    size = F.floor(F.log2("n") * 16).cast("int").alias("size")
    least: dict[str, int] = {}
    whole = True
    for part, rows in groupby(counts.groupBy("part", size).count().orderBy("part", F.desc("size")).collect(), key=lambda r: r["part"]):
        total = 0
        for r in rows:
            total += r["count"]
            if total > VOCABULARY and part != "sum":
                whole = False
                break
            least[part] = r["size"]
    keep = F.lit(False)
    for part, at in sorted(least.items()):
        keep = keep | ((F.col("part") == part) & (size >= at))
    return Model({(r["part"], r["token"]): r["n"] for r in counts.where(keep).select("part", "token", "n").toArrow().to_pylist()}, None if whole else counts.where(~keep))


def _rows(n: Counter) -> pa.RecordBatch:
    keys = list(n)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64())], ["part", "token", "n"])


def _rarer(docs: DataFrame, model: Model, rest: DataFrame) -> DataFrame:
    """(h, more): the counts in rest of the tokens that the texts of a hash ask for and the model lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                asked = Asked(model)
                sentence_ends(t, asked)
                out += [(h, *x) for x in asked.lacks]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["h", "part", "token"])

    lacks = docs.select("h", "text").mapInArrow(run, "h string, part string, token string").distinct()
    return lacks.join(rest, ["part", "token"]).groupBy("h").agg(F.collect_list(F.struct("part", "token", "n")).alias("more"))


def sentences(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, sent_no, start_char, end_char): the sentence units of each text with their places.

    The model is learned from the same texts if none is given. Null, empty and blank texts have no units; a text of
    repeated rows is split for each of them; other columns are ignored.
    """
    docs = documents.select("doc_id", "text")
    model = model or learn(docs)
    rest, model = model.rest, model.held()
    if rest is None:
        docs = docs.withColumn("more", F.lit(None).cast(MORE))
    else:
        docs = docs.where("text is not null").withColumn("h", F.md5("text"))
        docs = docs.join(_rarer(docs, model, rest), "h", "left").select("doc_id", "text", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nos, starts, ends = [], [], [], []
            for i, t, more in zip(*(c.to_pylist() for c in b.columns)):
                a = 0
                for k, e in enumerate(sentence_ends(t, model.plus({(m["part"], m["token"]): m["n"] for m in more}) if more else model)):
                    piece = t[a:e]
                    ids.append(i), nos.append(k), starts.append(a + len(piece) - len(piece.lstrip())), ends.append(e)
                    a = e
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int32()) for x in (nos, starts, ends))], ["doc_id", "sent_no", "start_char", "end_char"])

    return docs.mapInArrow(run, "doc_id bigint, sent_no int, start_char int, end_char int")
