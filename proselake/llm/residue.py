"""Template residue and error-page text.

Two ways lead to a verdict. Unresolved slots and values that failed to print are looked for in the lines themselves.
Messages are mined as templates: a linear classifier (naive Bayes over words, pairs of characters in scripts without
spaces; evidence for prose counts as none) is fitted on examples that the message patterns generate, against the
sentences of all documents. Its threshold is the least score of all sentences that the patterns describe, found by
following the patterns and not from the examples, so that it passes each of them. Sentences it passes go into prefix trees
of fixed depth: numbers and file names are masked, the path is the number of tokens and the first DEPTH tokens, the
leaf holds the sentences of that path. The trees of all partitions are merged by the shuffle; where the siblings of a
leaf differ in more than BRANCHES tokens at one place, the place becomes a slot. Each merged template is judged once by
the exact patterns, and its verdict goes back to every document that holds it; a sentence of which words became slots is
judged by itself too, so that prose beside a message can't hide it.

What a code block shows is never looked at; a message counts only where a sentence begins with it and isn't quoted, so
that a story may speak of one.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselake.llm.repetition import UNSPACED
from proselake.session import materialize

#: Tokens of a path; different tokens at one place of a leaf beyond which it is a slot.
DEPTH, BRANCHES = 3, 8
#: The classifier: generated examples a pattern, greatest weight of a word.
EXAMPLES, MOST_WEIGHT, SEED = 400, 6.0, 5
#: Classes of words: those that end in one, begin with one, and the status codes.
ENDINGS, BEGINNINGS, STATUS_CODE = ("error", "exception", "javascript"), ("asdfgh", "serverfehler"), "404"
#: Different words of the filler text that a sentence of it holds at least.
FILLER_LEAST = 3

# Words of the customary filler text.
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse "
    "cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# How messages begin, by language; matched at the start of a sentence in lower case.
MESSAGES = [
    # error pages and servers
    r"(?:http |error |status |code )*[45]\d\d\b\W*(?:error\b|page\b|file\b|not found|forbidden|unauthori[sz]ed|bad |service |internal |gateway|too many|gone\b|access|server)",
    r"(?:the )?(?:page|file|document|resource|url|link|chapter|article)s? (?:(?:was|were|is|are|could|can)(?: not|n't)?(?: be)? |not |cannot be )(?:found|displayed|located|opened)",
    r"the (?:page|file|document|resource|link|url|chapter|article|address) (?:that )?(?:you (?:asked|are looking|were looking|requested|tried|wanted)|requested)\b",
    r"(?:that|this|the) (?:link|page) (?:is|seems|appears to be|may be) (?:broken|missing|gone)",
    r"(?:internal |unexpected )?server error|bad gateway|gateway time-?out|service (?:is )?(?:temporarily |currently )?unavailable|proxy error|bad request\b",
    r"(?:http )?error \d+\b|(?:error|status) code:? \d+|(?:fatal|parse|syntax|database|runtime|unexpected|application|connection|script|php|sql|unknown|critical) (?:error|warning|notice)\s*[:(]",
    r"(?:uncaught|unhandled) (?:exception|error|typeerror)|traceback \(most recent|[a-z]+(?:error|exception): |warning: [a-z_]+\(|stack trace:|segmentation fault",
    r"(?:an?|some) (?:unexpected |unknown |internal |server |application )?(?:error|problem) (?:has |have )?(?:occurred|happened)|something (?:has gone|went) wrong",
    r"(?:whoops|oops|uh[- ]oh|we(?:'|’| a)re sorry|sorry)\W.{0,60}\b(?:wrong|broken|link|error|page|found|available|unavailable|problem|exist)",
    r"too many requests|rate limit exceeded|slow down and retry|(?:the )?connection (?:to .{1,40} )?(?:has )?(?:timed out|was reset|was refused|refused|failed|was closed)|(?:the |your )?request (?:has )?(?:timed out|failed|was blocked|could not be)",
    r"(?:we )?(?:could not|couldn't|cannot|can't|unable to|failed to) (?:connect to|load|open|reach|fetch|display|find) (?:the |this |that |your )?(?:page|site|server|file|content|database|resource|host|chapter|document|text)",
    r"upstream (?:did not|failed|request|server|connect)|the server (?:could not|cannot|is (?:busy|down|not responding)|encountered|did not|returned|refused|took too long)",
    r"(?:this|the|our) (?:site|website|page|service) is (?:currently |temporarily )?(?:down|under maintenance|under construction|offline|unavailable|not available)",
    r"(?:this|the|your) (?:content|page|text|video|article|chapter|file) (?:is|could|can) ?(?:not|n't|no longer|currently|temporarily)? ?(?:be )?(?:available|unavailable|loaded|displayed|blocked)(?! to| for| from| in| at)\b",
    # denied access, required scripts
    r"access (?:to this (?:page|site|resource|content) )?(?:is |was |has been )?(?:denied|forbidden|restricted)\b(?! to)|permission denied|forbidden\W*$",
    r"you (?:do not|don't|don’t) have (?:the )?(?:necessary |required )?(?:permissions?|access|rights) to|you are not (?:authori[sz]ed|allowed|permitted) to (?:view|access|see|read|open)",
    r"(?:please )?(?:log|sign) ?in (?:again |first )?to (?:continue|read|view|see|access|proceed)|your session (?:has )?(?:expired|timed out|ended)|session (?:expired|timed out)",
    r"(?:please |you (?:must|need to|have to|should) )?(?:enable|turn on|switch on|activate|allow)(?: the use of)? (?:javascript|java script|scripts?|scripting|cookies)\b",
    r"(?:this|the|our) (?:site|website|page|app|application|content|text|reader) (?:needs|requires|uses|relies on|works best with|will not work without|does not work without) .{0,30}(?:script|cookie)",
    r"(?:javascript|scripts?|cookies) (?:is|are|must be|has been|have been|seems?|appears?|need to be|needs to be) .{0,20}(?:required|disabled|enabled|off|blocked|switched|turned|needed)",
    r"your browser (?:does not|doesn't|has|is) .{0,40}(?:support|disabled|script|cookie|out of date|blocked)",
    r"checking (?:if |that )?(?:your|the) (?:browser|connection|site)|verif(?:y|ying) (?:that )?you are (?:a )?human|(?:please )?(?:complete|solve) the captcha|are you a robot|attention required",
    # filler
    r"(?:your |the |main |more )?(?:text|sub-?heading|heading|title|subtitle|body|caption|content|description|name|summary|copy|paragraph|quote|chapter)(?: text)? (?:goes|will go|comes|should go) here",
    r"(?:add|enter|insert|type|write|put|replace|place)(?: in)? (?:your|the|a|an|this|some)(?: own)? (?:caption|title|text|body|content|heading|description|story|summary|name|copy|chapter|paragraph)(?: of the (?:story|text|chapter|article))?(?: text)?(?: here| below| before publishing)?\W*(?:$|\()",
    r"\[?(?:text|content|copy|image|caption|more|details|body|title|chapter|illustration|abstract|summary) (?:to come|tbd|tba|tk|pending|to follow)\b",
    r"\[?(?:todo|tbd|fixme|tk)\s*[:\-–—\]]|(?:todo|tbd|fixme)\W*$|(?:sample|dummy|placeholder|filler|example) (?:text|content|copy|paragraph|caption)\b(?! (?:of|from|in|was|is|on|for|that|by))",
    r"(?:(?:asdf|qwer|zxcv|hjkl|uiop|jkl|wert|sdfg|dfgh|fghj|xcvb|bnm|qwerty|asdfgh\w*|qwertz|azerty|yuiop)\b[\s,;.]*)+$",
    # French, German, Spanish
    r"page (?:introuvable|non trouvée|inexistante)|(?:erreur (?:\d+|interne|du serveur|serveur|fatale))|une erreur (?:est survenue|s'est produite|s’est produite)|accès (?:refusé|interdit|non autorisé)|vous n['’]avez pas (?:l['’]autorisation|la permission|accès)|(?:veuillez |merci d['’]|vous devez )?activer? (?:le )?(?:javascript|les cookies)|service (?:temporairement )?indisponible|(?:votre )?session (?:a )?expirée?|trop de requêtes|texte à venir|votre texte ici",
    r"(?:die |diese )?seite (?:wurde |konnte )?(?:leider )?nicht gefunden|(?:interner |ein )?(?:serverfehler|fehler \d+|fehler ist aufgetreten)|zugriff (?:wurde )?(?:verweigert|gesperrt|nicht erlaubt)|(?:bitte )?aktivieren sie (?:javascript|cookies|bitte)|(?:bitte )?javascript (?:aktivieren|ist deaktiviert)|dienst (?:vorübergehend )?nicht verfügbar|(?:ihre )?sitzung (?:ist )?abgelaufen|zu viele anfragen|text folgt|hier steht ihr text|sie haben keine berechtigung",
    r"(?:la )?página (?:no (?:fue )?encontrada|no existe|no disponible)|acceso (?:denegado|prohibido|restringido)|(?:por favor,? )?(?:active|activa|habilite|habilita|debe activar) (?:el )?(?:javascript|las cookies)|error (?:interno|del servidor|fatal|\d+)|(?:ha ocurrido|se ha producido|se produjo) un error|servicio (?:temporalmente )?no disponible|(?:su |tu )?sesión ha (?:caducado|expirado)|demasiadas (?:solicitudes|peticiones)|no tiene permiso|texto por venir|su texto aquí",
    # Russian, Chinese, Japanese, Thai, Hindi, Arabic
    r"страница не (?:найдена|существует)|доступ (?:к .{1,30} )?(?:запрещ[её]н|закрыт|ограничен|отклон[её]н)|(?:пожалуйста,? )?включите (?:javascript|cookie|поддержку)|(?:внутренняя )?ошибка (?:сервера|\d+|на сервере)|произошла ошибка|сервис (?:временно )?недоступен|(?:ваша )?сессия истекла|слишком много запросов|у вас нет (?:прав|доступа)",
    r"(?:该|此|您访问的|抱歉，?|对不起，?)*(?:页面|网页)(?:不存在|未找到|找不到|无法|已删除|不见了)|(?:您)?(?:访问被拒绝|拒绝访问|没有(?:访问)?权限|无权访问|禁止访问)|请(?:先)?(?:启用|开启|打开|允许|激活)\s*(?:javascript|脚本|cookie|浏览器)|(?:内部)?服务器(?:内部)?(?:出现)?错误|系统(?:错误|繁忙|出错)|找不到.{0,4}(?:页面|网页)|服务(?:暂时)?不可用|请求过多",
    r"(?:お探しの|この|指定された)?ページ(?:が|は)(?:見つかりません|存在しません|表示できません)|お探しのページ|アクセスが(?:拒否|禁止|制限)|アクセス権|(?:.{0,14})?javascript\s*を(?:有効|オン)|(?:内部)?サーバー?(?:内部)?(?:エラー|に接続)|エラーが発生|サービスは?(?:一時的に)?利用できません",
    r"ไม่พบ(?:หน้า|ไฟล์)|(?:การเข้าถึงถูกปฏิเสธ|ปฏิเสธการเข้าถึง|คุณไม่มีสิทธิ์|ไม่มีสิทธิ์)|(?:กรุณา|โปรด)?เปิด(?:ใช้งาน|ใช้)?\s*(?:javascript|คุกกี้)|(?:เกิด)?ข้อผิดพลาด(?:ของเซิร์ฟเวอร์|ภายใน|\s*\d)?|เซิร์ฟเวอร์(?:ขัดข้อง|ผิดพลาด)",
    r"(?:यह )?(?:पृष्ठ|पेज) (?:नहीं मिला|उपलब्ध नहीं|मौजूद नहीं)|(?:प्रवेश|पहुँच|पहुंच) (?:निषेध|निषिद्ध|अस्वीकृत|वर्जित)|(?:आपको )?(?:अनुमति नहीं|इसकी अनुमति नहीं)|(?:.{0,20})?javascript (?:चालू|सक्षम|सक्रिय)|(?:आंतरिक )?सर्वर (?:त्रुटि|में त्रुटि|की त्रुटि)|त्रुटि \d+|कोई त्रुटि",
    r"(?:عذرا،? ?)?(?:هذه )?الصفحة (?:غير موجودة|غير متاحة|لم)|لم يتم العثور على الصفحة|(?:تم رفض الوصول|الوصول مرفوض|ممنوع (?:الدخول|الوصول)|تم منع الوصول|رفض الوصول)|(?:يرجى |الرجاء |من فضلك )?(?:تفعيل|تمكين) (?:javascript|جافا)|خطأ (?:في الخادم|داخلي|\d+)|حدث خطأ|ليس لديك (?:إذن|صلاحية)",
]
MESSAGE = re.compile(r"[\s\d.)#*>|=-]*(?:" + "|".join(f"(?:{m})" for m in MESSAGES) + ")")
MESSAGE_AT_CODE = re.compile(r"\s*[45]\d\d\b\W*(?:-|–|—|:)?\s*(?:page|file|not|forbidden|unauthor|bad|service|internal|gateway|too many|error|access)")

_NAME = r"[A-Za-z_][\w]*(?:[. ][A-Za-z_]\w*){0,3}"
# Forms of unfilled placeholders. Wiki templates (with a bar) and arguments of commands aren't among them.
SLOT = re.compile(
    rf"\{{\{{\{{?\s*[#/>&^]?\s*{_NAME}\s*(?:\|\s*\w+\s*)?\}}\}}|\{{%-?\s*{_NAME}[^%\n]{{0,40}}%\}}|\$\{{\s*{_NAME}\s*\}}|#\{{\s*{_NAME}\s*\}}|@@\s*{_NAME}\s*@@|<%[=-]?\s*[^%\n]{{1,60}}%>"
    rf"|(?<![\w%\d])%[A-Za-z_]\w*(?:\.\w+)?%(?![\w%])|(?<![\\\w}}\]^_$@#{{|])\{{\s*{_NAME}\s*\}}(?![}}\w{{])"
    rf"|\[\s*(?:INSERT|Insert|insert|ENTER|Enter your|Your|YOUR|ADD|TYPE)\s+[\w. ]{{2,40}}\]|\[\s*[\w. ]{{2,40}}\s+(?:HERE|GOES HERE|goes here|TBD|TK)\s*\]"
    r"|(?<![\w%])%(?:\(\w+\))?[sdif](?![\w%])|\[\[\s*(?:INSERT|YOUR)[\w ]+\]\]|<(?:INSERT|YOUR)[_ ][\w ]+>"
)
FAILED = re.compile(r"\[object \w+\]|\bInvalid Date\b|\bNaN of NaN\b|\bundefined undefined\b|\bnull null\b")
FAILED_VALUE = re.compile(r"(?<![\w.'’-])(?:undefined|null|NaN|None|nil|N/A)(?![\w'’-])")
FAILED_NONE = re.compile(r"\bNone\b[\s,:;/|-]*\bNone\b")
SLOT_CONTEXT = re.compile(r"^\W*(?:by|hello|dear|hi|title|author|chapter|date|published|posted|name|body|series|abstract|welcome(?: to)?|written by|filed under|from|page)\s*:?\s+(?:undefined|null|NaN|None|nil)\b", re.I)
CODE = re.compile(r"(?ms)^[ \t>]*(```|~~~).*?(?:^[ \t>]*\1[^\n]*$|\Z)|<(pre|code|samp|kbd|textarea|syntaxhighlight|source|nowiki)\b[^>]*>.*?(?:</\2\s*>|\Z)|&lt;(pre|code)\b.*?(?:&lt;/\3\s*&gt;|\Z)|\\begin\{(verbatim\*?|lstlisting|minted|alltt)\}.*?(?:\\end\{\4\}|\Z)|`[^`\n]+`", re.I)
MATH = re.compile(r"\$\$.*?\$\$|\$(?=[^$\n]*[\\^_=])[^$\n]+\$|\\\[.*?(?:\\\]|$)|\\\(.*?\\\)|\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})+|[_^]\{[^{}\n]*\}")
_TAGS = re.compile(r"</?[A-Za-z][^<>\n]*>")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s*(?=\S)|(?<=[।؟])\s+")
_QUOTE = "\"'“”‘’«»„「『‹"


_WORDS = re.compile(r"[^\W\d_]+|[45]\d\d(?!\d)")
_BY_SCRIPT = re.compile(f"{UNSPACED.pattern}+|[^{UNSPACED.pattern[1:-1]}]+")


@functools.lru_cache(maxsize=1 << 16)
def parts_of(word: str) -> tuple[str, ...]:
    """What stands for a run of letters or a status code: the word or its class; of scripts without spaces the pairs of characters."""
    if word[0].isdecimal():
        return (STATUS_CODE,)
    if not word.isascii() and UNSPACED.search(word):
        runs = _BY_SCRIPT.findall(word)
        if len(runs) > 1:
            return tuple(p for r in runs for p in parts_of(r))
        return tuple(word[i : i + 2] for i in range(len(word) - 1)) or (word,)
    return (next((e for e in ENDINGS if word.endswith(e)), None) or next((b for b in BEGINNINGS if word.startswith(b)), word),)


def words_of(low: str) -> list[str]:
    """What the classifier looks at in a text in lower case."""
    return list(chain.from_iterable(map(parts_of, _WORDS.findall(low))))


parsed = functools.lru_cache(re._parser.parse)  # type: ignore[attr-defined]


def generated(pattern: str, rng: random.Random) -> str:
    """A string that the pattern describes; of free parts a filler."""

    def walk(items) -> str:
        out = []
        for op, v in items:
            name = str(op)
            if name == "LITERAL":
                out.append(chr(v))
            elif name == "BRANCH":
                out.append(walk(rng.choice(v[1])))
            elif name == "SUBPATTERN":
                out.append(walk(v[3]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, sub = v
                out += [walk(sub) for _ in range(rng.randint(low, min(int(high), low + 1)))]
            elif name == "IN":
                kind, first = rng.choice(v)
                kind = str(kind)
                out.append(chr(first) if kind == "LITERAL" else chr(first[0]) if kind == "RANGE" else "4" if "DIGIT" in str(first) else " ")
        return "".join(out)

    return walk(parsed(pattern))


#: Of an unfinished word in `least_score`: letters that the pattern leaves open; the word must end here.
OPEN, END = "\0", "\1"


def least_of(run: str, weights: dict[str, float]) -> float:
    """The least score of a run of letters or digits, with whatever letters stand for OPEN."""
    run, get = run.removesuffix(END), weights.get
    if OPEN not in run:
        return sum(get(w, 0.0) for w in words_of(run))
    total = 0.0
    for r in _BY_SCRIPT.findall(run):
        if UNSPACED.match(r):
            total += sum(get(r[i : i + 2], 0.0) for i in range(len(r) - 1))
        elif OPEN not in r:
            total += sum(get(p, 0.0) for p in parts_of(r))
        elif r.endswith(ENDINGS) or r.startswith(BEGINNINGS):
            total += min(get(c, 0.0) for c in (*ENDINGS, *BEGINNINGS))
    return total


def least_score(pattern: str, weights: dict[str, float]) -> float:
    """The least score of all sentences that begin as the pattern describes.

    All its alternatives are followed; a state is the unfinished word and the least score of what came before. A free part
    may end the word or go on with it, and so may whatever follows the pattern. Conditions other than borders of words
    are passed over, which can only lessen the result.
    """

    def least(many: list[dict[str, float]]) -> dict[str, float]:
        out: dict[str, float] = {}
        for states in many:
            for run, score in states.items():
                out[run] = min(score, out.get(run, math.inf))
        return out

    def then(states: dict[str, float], c: str) -> dict[str, float]:
        many = []
        for run, score in states.items():
            if c != OPEN and not c.isalnum():
                many.append({"": score + least_of(run, weights)})
            elif run.endswith(END):
                continue
            elif run[-1:].isdecimal() and c == OPEN:  # might be one more digit
                many.append({c: score})
            elif run and run[-1].isdecimal() != c.isdecimal():
                many.append({c: score + least_of(run, weights)})
            else:
                many.append({run + c: score})
        return least(many)

    def free(states: dict[str, float]) -> dict[str, float]:
        return least([then(states, OPEN), then(states, " ")])

    def one_of(states: dict[str, float], kind: str, v) -> dict[str, float]:
        if kind == "LITERAL":
            return then(states, chr(v))
        if kind == "CATEGORY" and str(v).endswith(("NOT_WORD", "_SPACE")):
            return then(states, " ")
        if kind == "CATEGORY" and str(v) == "CATEGORY_DIGIT" or kind == "RANGE" and chr(v[0]).isdecimal():
            return then(states, "4")
        return free(states)

    def walk(items, states: dict[str, float]) -> dict[str, float]:
        for op, v in items:
            name = str(op)
            if name == "BRANCH":
                states = least([walk(b, states) for b in v[1]])
            elif name == "SUBPATTERN":
                states = walk(v[3], states)
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, sub = v
                for _ in range(low):
                    states = walk(sub, states)
                # of a free part: the rest of a word, a border, the beginning of a word; of others one more, as more only add words
                for _ in range(min(int(high) - low, 3)):
                    states = least([states, walk(sub, states)])
            elif name == "IN":
                states = least([one_of(states, str(kind), x) for kind, x in v])
            elif name == "AT" and str(v) in ("AT_BOUNDARY", "AT_END"):
                states = least([{run + END if run and not run.endswith(END) else run: score} for run, score in states.items()])
            elif name in ("LITERAL", "ANY"):
                states = one_of(states, name, v)
            elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
                raise ValueError(f"{name} in a pattern")
        return states

    ends = least([{run: s} if not run or run.endswith(END) else then({run: s}, OPEN) for run, s in walk(parsed(pattern), {"": 0.0}).items()])
    return min(score + least_of(run, weights) for run, score in ends.items())


def examples() -> list[str]:
    """Messages that the patterns generate, and filler text."""
    rng = random.Random(SEED)
    out = [generated(m, rng) for m in (*MESSAGES, MESSAGE_AT_CODE.pattern) for _ in range(EXAMPLES)]
    filler = sorted(FILLER_WORDS)
    return out + [" ".join(rng.choices(filler, k=rng.randint(4, 12))) for _ in range(EXAMPLES)]


class Gate:
    """The fitted classifier: weights of words, and the score from which a sentence may be a message."""

    def __init__(self, weights: dict[str, float], least: float) -> None:
        self.weights, self.least = weights, least

    def passes(self, low: str) -> bool:
        weights, words = self.weights, words_of(low)
        return sum([weights[w] for w in words if w in weights]) >= self.least or len(FILLER_WORDS.intersection(words)) >= FILLER_LEAST


def fit_gate(documents: DataFrame) -> Gate:
    """Collected: how many sentences of all documents hold each word of the examples, so no more rows than these have words."""
    told = [s for s in examples() if words_of(s.lower())]
    n: Counter = Counter()
    for s in told:
        n.update(set(words_of(s.lower())))
    known = frozenset(n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                sentences = _SENTENCE.split((t or "").lower())
                seen.update(w for s in sentences for w in known.intersection(words_of(s)))
                seen[""] += len(sentences)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    prose = {r.w: r.n for r in documents.where("text is not null").select("text").mapInArrow(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    rows = prose.pop("", 0) + 1
    weights = {w: min(MOST_WEIGHT, max(0.05, math.log((c + 0.5) / len(told) * rows / (prose.get(w, 0) + 0.5)))) for w, c in n.items()}
    return Gate(weights, min(least_score(m, weights) for m in (*MESSAGES, MESSAGE_AT_CODE.pattern)) * 0.999)


STATUS = re.compile(r"\(?[45]\d\d\)?")


def masked(token: str) -> str:
    """Status codes stay, bare numbers become 0, names with digits a wildcard; in scripts without spaces a token is a
    sentence, of which only the digits go."""
    if not any(map(str.isdigit, token)) or STATUS.fullmatch(token):
        return token
    if token.isascii() and not token.strip("[](){}.,:;").isdigit():
        return "<*>"
    return re.sub(r"\d+", "0", token)


class TemplateTree:
    """Prefix tree of fixed depth: number of tokens, DEPTH tokens, then the sentences of that path with their masked tokens."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.held = 0

    def add(self, sentence: str) -> str:
        """The masked sentence; its tokens are kept at their leaf once."""
        tokens = tuple(map(masked, sentence.split()))
        node = self.root
        for t in (len(tokens), *tokens[:DEPTH]):
            node = node.setdefault(t, {})
        if tokens not in node:
            self.held += 1
            node[tokens] = " ".join(tokens)
        return node[tokens]


#: Strings without one of which a line holds no slot and no failed value.
SLOT_HINTS = ("{", "%", "@@", "[", "<", "undefined", "null", "NaN", "None", "nil", "N/A", "Invalid Date")


def has_slot(line: str) -> bool:
    """Whether a line holds an unfilled placeholder or a value that failed to print."""
    if "{" in line or "%" in line or "@@" in line or "[" in line or "<" in line:
        if SLOT.search(MATH.sub(" ", line)):
            return True
    if FAILED.search(line):
        return True
    # None alone is a word; before or beside another value, or before a mark, it is a value
    failed = FAILED_VALUE.findall(line)
    return bool(failed) and (SLOT_CONTEXT.match(line) is not None or len(failed) >= 2 and (len({*failed} - {"None"}) > 0 or FAILED_NONE.search(line) is not None))


def sentences_of(line: str) -> list[str]:
    plain = html.unescape(_TAGS.sub(" ", html.unescape(line))).strip()
    return [s for s in (x.strip() for x in _SENTENCE.split(plain)) if s]


def classify(template: str) -> bool:
    """Whether a template of a sentence is a message or filler."""
    if template[:1] in _QUOTE:
        return False
    low = template.lower()
    words = re.findall(r"[^\W\d_]+", low)
    if len(words) >= 4 and sum(w in FILLER_WORDS for w in words) >= 0.7 * len(words) and len({*words} & FILLER_WORDS) >= FILLER_LEAST:
        return True
    return bool(MESSAGE.match(low) or MESSAGE_AT_CODE.match(low))


def _scan(text: str, tree: TemplateTree, gate: Gate) -> tuple[bool, list[str]]:
    """(a slot was found, templates of sentences that may be messages)."""
    if "`" in text or "<" in text or "\\begin" in text or "~~~" in text or "&lt;" in text:
        text = CODE.sub("\n", text)
    slot, found = False, []
    hints = any(x in text for x in SLOT_HINTS)
    for line in text.split("\n"):
        slot = slot or hints and any(x in line for x in SLOT_HINTS) and has_slot(line)
        low = html.unescape(html.unescape(line)).lower() if "&" in line else line.lower()
        # no weight is negative, so no sentence scores more than its line
        if gate.passes(low):
            found += [tree.add(s) for s in sentences_of(line) if gate.passes(s.lower())]
    return slot, found


def residue_evidence(documents: DataFrame, gate: Gate) -> DataFrame:
    """(doc_id, slot, template): a row for each document with a slot (template null) and each masked sentence in it that the classifier passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TemplateTree()
        for b in batches:
            ids, slots, templates = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                slot, found = _scan(t, tree, gate)
                if slot:
                    ids.append(i), slots.append(True), templates.append(None)
                for f in dict.fromkeys(found):
                    ids.append(i), slots.append(False), templates.append(f)
            if tree.held > 200_000:
                tree = TemplateTree()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(slots, pa.bool_()), pa.array(templates, pa.string())], ["doc_id", "slot", "template"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, slot boolean, template string")


def merged_templates(evidence: DataFrame, branches: int = BRANCHES) -> DataFrame:
    """(template, merged): each masked sentence with the template of its leaf in the merged tree, slots where siblings differ."""
    tokens = F.split("template", " ")
    path = F.xxhash64(F.size(tokens), F.slice(tokens, 1, DEPTH))
    kinds = evidence.where("template is not null").select("template").distinct().select("template", path.alias("leaf"), tokens.alias("tokens"))
    places = kinds.select("leaf", F.posexplode("tokens").alias("place", "token")).where(F.col("place") >= DEPTH).distinct()
    slots = places.groupBy("leaf", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > branches).groupBy("leaf").agg(F.collect_set("place").alias("slots"))
    merged = F.transform("tokens", lambda t, i: F.when(F.array_contains("slots", i), F.lit("<*>")).otherwise(t))
    return kinds.join(slots, "leaf", "left").select("template", F.when(F.col("slots").isNull(), F.col("template")).otherwise(F.array_join(merged, " ")).alias("merged"))


def message_templates(evidence: DataFrame) -> DataFrame:
    """(template): the masked sentences that are a message or filler by their merged template, judged once, or before words became slots; some twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t for t in b.column(0).to_pylist() if classify(t)], pa.string())], b.schema.names)

    both = materialize(merged_templates(evidence))
    by_merged = both.join(both.select("merged").distinct().mapInArrow(run, "merged string"), "merged", "left_semi").select("template")
    return by_merged.unionByName(both.where("template <> merged").select("template").mapInArrow(run, "template string"))


def with_residue(documents: DataFrame) -> DataFrame:
    """(doc_id) of documents that hold template residue, filler, error messages or notices.

    Null and empty texts hold none; of repeated rows each doc_id comes once; other columns are ignored.
    """
    docs = documents.select("doc_id", "text")
    seen = materialize(residue_evidence(docs, fit_gate(docs)))
    by_message = seen.join(message_templates(seen), "template", "left_semi").select("doc_id")
    return seen.where("slot").select("doc_id").unionByName(by_message).distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The rows of documents that hold none."""
    return documents.join(with_residue(documents).select(F.col("doc_id").alias("__bad")), F.col("doc_id") == F.col("__bad"), "left_anti")
