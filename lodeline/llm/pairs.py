"""Problem 5: broken prompt and response pairs.

Method: prompt and response are aligned by shingle containment and longest
common subsequence to flag copies, and the tokens of each sentence of the
response are aligned against refusal templates, sequences of slots with
alternatives, to flag refusals. Empty and truncated replies are read off the
response and its end, other languages off character n-grams (see `language`).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodeline.llm.common import keyed, renamed
from lodeline.llm.language import HAN, LATIN, differ, language

#: Letters and digits left of a reply that says nothing: placeholders and labels that stand alone.
NOTHING = {
    "", "null", "none", "nil", "na", "nan", "undefined", "empty", "noanswer", "noreply", "noresponse", "noresult", "tbd", "todo", "pending", "placeholder", "answer", "answers", "reply", "response", "solution", "blank",
    "theanswer", "assistant", "tutor", "答", "答案", "回答", "解答", "回复", "解", "无", "暂无", "空", "没有", "无回答", "暂无回答", "无答案", "暂无答案", "待补充", "略", "助教", "réponse", "reponse", "laréponse", "aucune", "aucuneréponse", "sansréponse",
    "pasderéponse", "respuesta", "larespuesta", "sinrespuesta", "ninguna", "solución", "antwort", "dieantwort", "keineantwort", "keine", "lösung", "leer", "vide", "vacío", "risposta", "nessunarisposta", "resposta", "semresposta", "geenantwoord", "ответ", "нетответа",
    "回答なし", "なし", "답변", "답변없음", "없음",
}
SILENT = regex.compile(r"[^\p{L}\p{N}\p{M}]+|[\uFE00-\uFE0F]+")
#: A label with a colon and nothing behind it.
LABEL_ONLY = re.compile(r"\W*[^\W\d_][\w'’]*(?: [^\W\d_][\w'’]*){0,2}\s*[:：]\W*")
#: Refusal templates. Slots follow each other within `gap` tokens, alternatives are parted by bars. `gap` 3 means words, 8 and 6 mean characters of scripts without spaces.
TEMPLATES_TEXT = """
3 / i|we|sorry|unfortunately|afraid|policy / cannot|can not|could not|will not|would not|unable to|not able to|not going to|must decline|must refuse|have to decline|have to refuse|decline|refuse|would rather not|rather not|prefer not|not allowed to|not permitted to|not in a position to|not comfortable|not willing to / help|assist|answer|answering|respond|reply|do|discuss|discussing|provide|talk|say|go into|comply|process|share|comment|fulfil|fulfill|handle|support|continue|engage|address|this|that|be answering|be able
3 / this|that|your|the|such / request|question|topic|message|one|subject|content / cannot|can not|could not|will not|is not / be processed|be answered|be handled|be completed|be fulfilled|be discussed|supported|allowed|permitted
3 / this|that|it|request|question|topic / is outside|is beyond|falls outside|goes beyond|is out of|is not something|not a thing|is against / i|my|me|scope|we|rules|policy|guidelines
3 / je|il|nous / ne peux pas|ne puis|ne suis pas en mesure|ne suis pas autorisé|ne suis pas capable|refuse|dois refuser|dois décliner|préfère ne pas|m est impossible|ne souhaite pas|ne veux pas|ne saurais|ne pouvons pas / répondre|aider|traiter|parler|faire|donner|fournir|discuter|satisfaire|dire|en parler|cette|ça|cela
3 / cette|votre|ta|ce|la / demande|question|requête|sujet / ne peut pas|ne peut|n est pas|dépasse / traitée|être traitée|aboutir|acceptée|autorisée|mes|possible|répondue
4 / ich|mir|wir|dazu|dabei|damit|hierbei|das / kann|können|darf|dürfen|möchte|will|werde|muss|bin|ist / nicht|nichts|ablehnen|unmöglich|verweigern|außerstande / helfen|beantworten|antworten|sagen|sprechen|weiterhelfen|bearbeiten|unterstützen|möglich|dienen|äußern|tun|in der lage|erlaubt
4 / ich|muss / muss|lehne|verweigere|möchte / ablehnen|ab|leider ablehnen|verweigern|die antwort
4 / diese|dieser|ihre|deine|die / anfrage|frage|bitte|aufgabe|thema / kann|darf|ist / nicht / bearbeitet|beantwortet|erlaubt|möglich|zulässig|beantworten|antworten|helfen
4 / frage|anfrage|bitte / darf|kann|möchte|werde / ich|leider / nicht / beantworten|bearbeiten|erfüllen
3 / no|yo|prefiero|debo|tengo|me / puedo|podré|puede|me es posible|estoy en condiciones|estoy autorizado|estoy autorizada|me está permitido|voy a|quiero|no|rechazar|que rechazar|declinar|niego a / ayudar|ayudarte|ayudarle|ayudarlo|ayudarla|responder|responderte|contestar|contestarte|procesar|hablar|dar|hacer|hacerlo|tratar|atender|decir|esta|eso|esto|la
3 / esta|su|tu|la / petición|solicitud|pregunta|consulta / no se puede|no puede|no está / procesar|ser|permitida|atender|responder|tramitar
3 / non|preferisco|devo|mi / posso|possiamo|sono in grado|è possibile|è permesso|non|rifiutare|declinare|rifiuto di|mi è possibile|voglio / aiutarti|aiutarla|aiutare|aiutarvi|rispondere|risponderti|parlare|parlarne|farlo|fornire|trattare|soddisfare|questa|questo|di
3 / não|prefiro|devo|tenho / posso|consigo|podemos|me é possível|estou autorizado|estou autorizada|vou|não|recusar|que recusar / ajudar|ajudá|ajudar te|responder|falar|fazer|fornecer|processar|atender|dizer|esta|essa|este
4 / ik|we|dat|daar|hierbij / kan|kunnen|mag|wil|moet|zal / niet|niets|geen|weigeren|helaas / helpen|beantwoorden|antwoorden|zeggen|geven|doen|over praten|weigeren|op antwoorden
3 / я|к сожалению|извините|простите|мы|не|вынужден|отказываюсь / не могу|не можем|не в состоянии|не смогу|могу|отказаться|отказать|не имею права|не вправе|отвечать|от / помочь|ответить|отвечать|выполнить|обсуждать|сделать|обработать|ответа|этот|это|вам
8 / 我|恕|对不起|抱歉|遗憾|不好意思|这|该|此|本|作为|根据|很|请求|问题|话题 / 不能|无法|没法|没办法|不便|不方便|不可以|不会|不予|不想|不愿|拒绝|难以|不宜|不合适|不适合|不得|无权|不允许 / 回答|解答|作答|帮|协助|提供|处理|从命|满足|讨论|回应|完成|奉告|由我|透露|答复|继续|参与|给出|做到|谈|聊|答你|答这
8 / 难从命|无可奉告|答不了|帮不了|回答不了|处理不了|做不了|帮不上|不支持此|不支持该|不支持这|不支持您|不予解答|不予回答|不说了|超出了我|超出我|超出能力|拒绝回答|谢绝|不便回答|不便作答
6 / お|ご|回答|対応|答|手伝|応|提供|協力|助け|申し訳|それ|その / できません|られません|かねます|できない|られない|お断り|ご遠慮|控えさせ|いたしかね|出来ません|えません|じられません
6 / 답변|대답|도와|도움|제공|처리|죄송|요청|질문|말씀 / 수 없|드릴 수 없|할 수 없|어렵습니다|불가|거절|못 합니다|못합니다|못해|없습니다
3 / لا|لن|آسف|عذرا|اعتذر|للأسف / أستطيع|يمكنني|أقدر|استطيع|أتمكن|يمكن / مساعدتك|الإجابة|المساعدة|الرد|تلبية|معالجة|أجيب|أساعدك
3 / मैं|माफ़|क्षमा|मुझे|यह / नहीं|असमर्थ|इनकार|मना / सकता|सकती|दे|कर|हूँ|करता|करती
6 / ขอโทษ|ขออภัย|ฉัน|ผม|เรา|เสียใจ|ดิฉัน / ไม่สามารถ|ไม่อาจ|ช่วยไม่ได้|ตอบไม่ได้|ขอปฏิเสธ|ไม่ได้ / ตอบ|ช่วย|ให้|ทำ|ดำเนินการ|คำ|ครับ|ค่ะ
""".strip().split("\n")
#: Contractions spelt out before the tokens are taken.
CONTRACTED = [(re.compile(p, re.I), r) for p, r in ((r"[’ʼ`]", "'"), (r"\bcan't\b", "cannot"), (r"\bwon'?t\b", "will not"), (r"n't\b", " not"), (r"'m\b", " am"), (r"'d\b", " would"), (r"'s\b", " is"), (r"'ll\b", " will"), (r"'re\b", " are"))]
APOSTROPHE = re.compile("['’ʼ`]")
TOKEN = re.compile(r"[㐀-鿿぀-ヿ가-힣฀-๿]|[^\W\d_㐀-鿿぀-ヿ가-힣฀-๿]+(?:̀|[ऀ-्])*|\d+")
QUOTED = re.compile(r"“[^”]*”|「[^」]*」|『[^』]*』|«[^»]*»|„[^“”]*[“”]|\"[^\"\n]*\"|(?<!\w)'[^'\n]*'(?!\w)|‘[^’]*’(?!\w)")
WORDY = re.compile(r"\w")
STOP = re.compile(r"[。！？!?…؟।॥\n]+|\.(?=\s|$)|\.(?=[^\W\d_])")
#: Most units (words, or half characters of scripts without spaces) of a sentence that can be nothing but a refusal, and of all that may stand beside it and still give no help.
LONG, SHORT = 32, 12
#: What stands before or around a repeated question.
FRAME = re.compile(
    r"^(?:你的问题是|你问的是|您的问题是|你问|题目|问题|原题|提问|you asked|you said|your question(?: is| was)?|question|the question(?: is| was)?|tu demandes|ta question|votre question|question posée|preguntas|tu pregunta|la pregunta|pregunta|deine frage|ihre frage|du fragst|frage|la tua domanda|domanda|a tua pergunta|pergunta|je vraag|vraag|質問|질문|вопрос)\s*[:：]?\s*",
    re.I,
)
BARE = re.compile(r"[\d\s.,:/%+\-−×÷*=()²³<>≈]*(?:cm|mm|dm|km|m|kg|g|mg|ml|l|h|min|s|°c|€|¥|\$)?[²³]?", re.I)
LABELLED = re.compile(r"\s*[\w\s]{1,14}[:：]\s*\S.{0,40}$", re.S)
ITEM_ONLY = re.compile(r"\s*(?:[-•*–]|\(?[0-9０-９]{1,3}\s*[.)、．）]|[（(][0-9]{1,3}[)）])\s*$")
#: The prompt asks for an answer in another language.
NAMED = r"(?:english|chinese|french|german|spanish|japanese|korean|italian|portuguese|dutch|russian|arabic|hindi|thai)"
ASKS = re.compile(
    r"(?:用|以)\s*(?:英语|英文|中文|汉语|法语|法文|德语|德文|西班牙语|西语|日语|韩语|俄语|泰语|阿拉伯语|意大利语|葡萄牙语)\s*(?:来)?\s*(?:回答|作答|解释|说明|讲|回复|告诉|写)|翻译成|译成|翻成"
    rf"|\b(?:answer|reply|respond|explain|write|tell me|say it|say that)\b[^.?!:]{{0,20}}\bin {NAMED}\b"
    r"|\b(?:réponds?|répondez|explique)\b[^.?!:]{0,20}\ben (?:anglais|chinois|français|allemand|espagnol|japonais|italien)\b"
    r"|\b(?:responde|contesta|explica)\w*\b[^.?!:]{0,20}\ben (?:inglés|chino|francés|alemán|español|japonés|italiano)\b"
    r"|\b(?:antworte|antworten|erkläre?)\b[^.?!:]{0,20}\bauf (?:englisch|chinesisch|französisch|deutsch|spanisch|japanisch|italienisch)\b"
    r"|\bauf (?:englisch|chinesisch|französisch|deutsch|spanisch|japanisch|italienisch) (?:antworten|erklären)\b"
    r"|\btranslate\b|\btradui[st]|\btraduce\b|\btraduci\b|\btraduz\b|\bübersetze?|\bvertaal\b",
    re.I,
)


def core(text: str) -> str:
    """Letters, marks and digits only, compatibility forms and case folded."""
    return SILENT.sub("", unicodedata.normalize("NFKC", text).casefold())


def _plain(text: str) -> str:
    if APOSTROPHE.search(text):
        for pattern, put in CONTRACTED:
            text = pattern.sub(put, text)
    return unicodedata.normalize("NFC", text).casefold()


def tokens(text: str) -> list[str]:
    """Words of spaced scripts, single characters of the others, numbers."""
    return TOKEN.findall(_plain(text))


@cache
def templates() -> list[tuple[int, list[dict[str, list[list[str]]]], list[set[str]]]]:
    """(gap, slots, the slots' possible first tokens) of each template; a slot maps a first token to its token sequences."""
    out = []
    for line in TEMPLATES_TEXT:
        gap, *slots = line.split(" / ")
        by_first: list[dict[str, list[list[str]]]] = []
        for s in slots:
            by_first.append({})
            for a in map(tokens, s.split("|")):
                by_first[-1].setdefault(a[0], []).append(a)
        out.append((int(gap), by_first, sorted((set(b) for b in by_first), key=len)))
    return out


def align(words: list[str], gap: int, slots: list[dict[str, list[list[str]]]]) -> tuple[int, int] | None:
    """Where a template's slots stand in order in a sentence, each within `gap` tokens of the one before: (start, end) of the shortest such stretch, None if they don't."""
    ends: dict[int, int] = {}  # end -> latest start
    for n, slot in enumerate(slots):
        now: dict[int, int] = {}
        for i, w in enumerate(words):
            for alternative in slot.get(w, ()):
                if words[i : i + len(alternative)] == alternative:
                    begin = i if n == 0 else max((ends[e] for e in range(i - gap, i + 1) if e in ends), default=-1)
                    if begin >= 0:
                        end = i + len(alternative)
                        now[end] = max(now.get(end, -1), begin)
        if not now:
            return None
        ends = now
    return min(((s, e) for e, s in ends.items()), key=lambda x: x[1] - x[0])


@cache
def cue() -> re.Pattern:
    """What any refusal must hold: an alternative of the second slot (the only one, where there is one) of some template."""
    found: set[str] = set()
    for _, slots, _ in templates():
        for alternatives in slots[min(1, len(slots) - 1)].values():
            found.update(r"\W*".join(map(re.escape, a)) for a in alternatives)
    return re.compile("|".join(sorted(found, key=len, reverse=True)))


def _units(words: Sequence[str]) -> float:
    return sum(0.5 if len(w) == 1 and w >= "฀" else 1.0 for w in words)


def refuses(sentence: str) -> bool:
    """The sentence is a refusal: its tokens align with a template and it says little else."""
    words = tokens(QUOTED.sub(" ", sentence))
    if not words or _units(words) > LONG:
        return False
    present = set(words)
    for gap, slots, firsts in templates():
        if any(present.isdisjoint(first) for first in firsts):
            continue
        found = align(words, gap, slots)
        rest = words[found[1] :] if found else []
        if found and _units(rest) <= SHORT and not any(w.isdigit() for w in rest):
            return True
    return False


def is_refusal(prompt: str, reply: str) -> bool:
    """At least one sentence refuses, and the others give no help: they are short together and hold neither numbers nor two words of the question."""
    if not cue().search(_plain(reply)) or ITEM_ONLY.search(reply.rsplit("\n", 1)[-1]):
        return False
    refused, rest = False, []
    for s in STOP.split(reply):
        if refuses(s):
            refused = True
        elif WORDY.search(s):
            rest.append(s)
    if not refused:
        return False
    words = [w for s in rest for w in tokens(s)]
    if _units(words) > SHORT or any(w.isdigit() for w in words):
        return False
    return len({w for w in tokens(prompt) if len(w) > 3}.intersection(words)) < 2


def is_truncated(reply: str) -> bool:
    """The end of the reply isn't the end of a sentence, a closing mark, a bare result or a labelled line."""
    text = reply.rstrip().rstrip("​").rstrip()
    line = text.rsplit("\n", 1)[-1]
    if "\n" in text and ITEM_ONLY.match(line):
        return True
    last = text[-1]
    kind = unicodedata.category(last)
    if any(text.count(a) > text.count(b) for a, b in ("“”", "「」", "『』", "《》", "«»", "（）")):
        return True
    if last in ".!?。！？…｡．؟।〜~။។" or kind in ("So", "Sk", "Pf", "Pe") or last in "\"'‍️":
        return False
    if kind in ("Po", "Ps", "Pi", "Pd", "Pc"):
        return True
    if BARE.fullmatch(line.rstrip()) or len(text) > len(line) and LABELLED.match(line):
        return False
    words = len(HAN.findall(text)) + len(LATIN.findall(text))
    return words > 2


def _unframed(reply: str) -> str:
    text = reply.strip()
    while (m := FRAME.match(text)) and m.end():
        text = text[m.end() :]
    return text


def lcs(a: str, b: str, least: int = 0, block: int = 512) -> int:
    """Length of the longest common subsequence, bit-parallel; exact where it reaches `least`, else some smaller number.

    An alignment of `least` characters skips at most len(a) - least of a and len(b) - least of b, so only places within that band are looked at, block by block.
    """
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    a, b, least = a[same:], b[same:], max(0, least - same)
    skip_a, skip_b = len(a) - least, len(b) - least
    if skip_a < 0 or skip_b < 0:
        return same
    total, low, row, width = same, 0, 0, 0
    for s in range(0, len(b), block):
        part = b[s : s + block]
        first, last = max(0, s - skip_b), min(len(a), s + len(part) + skip_a)
        if first > low:  # places that can't match any more
            gone = min(first - low, width)
            total += gone - (row & ((1 << gone) - 1)).bit_count()
            row >>= gone
            width -= gone
            low = first
        if last - low > width:
            row |= ((1 << (last - low - width)) - 1) << width
            width = last - low
        full = (1 << width) - 1
        places: dict[str, int] = dict.fromkeys(part, 0)
        for i, c in enumerate(a[low : low + width]):
            if c in places:
                places[c] |= 1 << i
        for c in part:
            u = row & places[c]
            row = (row + u | row - u) & full
    return total + width - row.bit_count()


def is_copy(prompt: str, reply: str) -> bool:
    """The reply is nothing but the prompt or most of it, once or many times, whatever its frame, spaces, marks and case. Shorter than six letters or of digits only, it must equal the prompt."""
    bare = _unframed(reply)
    b, a = core(bare), core(prompt)
    if not a:
        return False
    if len(b) < 6 or b.isdigit():
        return bool(b) and re.sub(r"\W", "", prompt) == re.sub(r"\W", "", bare) and re.sub(r"[\s\w]", "", bare) in re.sub(r"[\s\w]", "", prompt)
    if len(b) < 0.35 * len(a):
        return False
    if len(set(b).difference(a)) > 0.12 * len(b):
        return False
    n = 3 if len(b) < 40 else 5
    times = -(-len(b) // len(a))
    whole = a * times
    round_ = a + (a * (n // len(a) + 1))[:n] if times > 1 else a
    mine = {b[i : i + n] for i in range(len(b) - n + 1)}
    theirs = {round_[i : i + n] for i in range(len(round_) - n + 1)}
    if len(mine & theirs) < 0.75 * len(mine):
        return False
    least = -(-88 * len(b) // 100)
    return lcs(whole, b, least) >= least


def defect_of(prompt: str | None, reply: str | None) -> str | None:
    """Defect type of a pair, or None."""
    if reply is None or core(reply) in NOTHING or LABEL_ONLY.fullmatch(reply):
        return "empty"
    prompt = prompt or ""
    if is_copy(prompt, reply):
        return "echo"
    if is_refusal(prompt, reply):
        return "refusal"
    if is_truncated(reply):
        return "truncated"
    if differ(prompt, reply) and not ASKS.search(prompt):
        return "other_language"
    return None


def pair_defects(pairs: DataFrame, prompt_col: str, reply_col: str, keys: Sequence[str]) -> DataFrame:
    """`keys` and defect of each defective pair: `empty`, `echo`, `refusal`, `truncated` or `other_language`, the first that applies.

    A null or blank reply is `empty`, so is one of marks, a label or a placeholder; a null prompt is read as an empty text and can't be echoed. Texts of any length are read whole.
    Repeated rows give repeated results, an empty table none. Columns that are no keys are left out.
    """
    inner, names = keyed(pairs, keys, ("defect",), _prompt=pairs[prompt_col], _reply=pairs[reply_col])
    cols = [n for n, _ in names]
    schema = T.StructType([f for f in inner.schema.fields if f.name in cols] + [T.StructField("defect", T.StringType())])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = list(zip(pdf["_prompt"], pdf["_reply"], strict=True))
            seen = {p: defect_of(*p) for p in dict.fromkeys(both)}  # lives as long as the batch
            pdf["defect"] = [seen[p] for p in both]
            yield pdf.loc[pdf["defect"].notna(), [*cols, "defect"]]

    return renamed(inner.mapInPandas(judge, schema), names)


__all__ = ["align", "core", "defect_of", "is_copy", "is_refusal", "is_truncated", "language", "lcs", "pair_defects", "refuses", "tokens"]
