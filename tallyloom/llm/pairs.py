"""Broken prompt and response pairs: each defective pair with its one defect.

Method: a response is a candidate for a copy if, compressed with its prompt (and lead-ins such as `question:`) as a
zstandard dictionary, it costs at most COPY_SHARE of what it costs alone; the prompt and the window are taken whole,
whatever their length. A check of the words follows: a candidate that adds a word to its prompt, or changes one by
more than a slip of the pen, is no copy. Refusals and languages come from dictionaries; truncation from the
terminal-context statistics of `truncation`, learnt over all responses of the input.
"""

from __future__ import annotations

import difflib
import re
from functools import cache, lru_cache

import ahocorasick
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import textstate as ts, truncation
from .overlap import edits

ORDER = ["empty", "refusal", "copy", "truncated", "language"]
PLACEHOLDERS = frozenset("none null nan n/a na nil - -- --- – — . .. ... … ? tbd todo unknown undefined [no_response] [no_answer] [empty] [blank] (empty) (none) <empty> [none] [null] no_response no_answer empty [n/a] <none> <null>".split())

_THINK = re.compile(r"<think>.*?</think>\s*|<map>.*?</map>\s*", re.S)
_ANSWER = re.compile(r"<answer>(.*?)</answer>", re.S)
_TAGS = re.compile(r"</?[a-zA-Z]\w*>")
_LETTERS = re.compile(r"[^\W\d_]")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_QUOTED = re.compile(r"[“\"«„][^”\"»“]{0,80}[”\"»“]")
_MARKS = re.compile(r"[\W_]+")

_MEDIA = r"(?:this|these|the|that|those|any|your|such|provided|given)?\s*(?:provided |given |attached )?(?:video|videos|clip|clips|frame|frames|footage|image|images|recording|recordings|picture|pictures|photo|photos|media|file|scene|content|question|questions|one|request)"
#: Refusal phrases by language (matched on the lower-cased final answer).
REFUSALS = {
    "en": rf"(?:can't|cannot|can not|could not|couldn't|unable to|not able to|won't be able to|will not be able to|refuse to|decline to|must decline|not allowed to|not permitted to)\s+(?:really |reliably |possibly |even )?(?:answer|determine|help|assist|provide|say anything|give (?:an|you|any)|tell|respond|comment|discuss|identify|process|access|(?:view|watch|open|see|load|play|analy[sz]e|inspect|interpret|look at|make sense of|evaluate|review)\s+(?:{_MEDIA}))"
    r"|not enough information|insufficient information|lack the ability|no (?:means|way) of (?:seeing|watching|viewing|knowing|telling|opening)|(?:was|were) not (?:given|provided|shown)|(?:was|were)n't (?:given|provided|shown)|(?:do not|don't|did not|didn't) (?:see (?:the|this|these|any)|have (?:access|the ability|enough))|no access to|(?:outside|beyond) (?:of )?(?:what i|my|the scope)|inappropriate for me|would (?:only |just )?(?:mean|be|require) guess|(?:have to|must|will|i'll) (?:pass on|skip) (?:this|that|the)|(?:will|would) not (?:choose|pick|select) an (?:option|answer)"
    r"|(?:can ?not|can't|could not|couldn't) be (?:loaded|opened|played|viewed|analy[sz]ed|processed)|as an? (?:ai |large )?language model|i am (?:only |just |merely )?an? (?:ai|text|language|virtual)[a-z -]* (?:assistant|model)|(?:nothing|none)\b[^.]{0,60}\b(?:lets|allows|helps|enables) me|against my (?:guidelines|policy)|request (?:is |was )?(?:refused|declined|denied)|(?:does not|doesn't|do not|don't|won't) (?:allow|permit|let) me|(?:would|'d) rather not|prefer not to (?:answer|say|guess)|not possible (?:for me )?to (?:answer|say|tell|determine|judge|give|help|view|see)|upload (?:the|your|this) (?:file|video|clip|image|images|footage|recording)|(?:failed to|did not|didn't|would not|wouldn't|does not|do not|don't|could not|couldn't) (?:load|open|play|arrive)|without (?:seeing|access|watching)|nothing to (?:look at|go on)|i must refuse|i (?:respectfully )?decline|i refuse",
    "de": r"(?:kann|könnte|darf|möchte|werde)\b[^.]{0,60}\b(?:nicht|keine|kein)\b[^.]{0,40}(?:beantworten|sehen|öffnen|helfen|auskunft|geben|sagen|ansehen|antwort|bestimmen|erkennen)|kein(?:en)? zugriff|leider nicht (?:beantworten|möglich)|tut mir leid|keine auskunft|nicht genügend informationen|nicht beantworten|als sprachmodell",
    "fr": r"je ne (?:peux|puis|suis) pas|je ne saurais|désolé|impossible (?:pour moi|de répondre)|je n'ai pas accès|pas en mesure|en tant que modèle",
    "es": r"no puedo|lo siento|no me es posible|no tengo acceso|no soy capaz|como modelo de lenguaje|no es posible responder",
    "it": r"non posso|mi dispiace|non sono in grado|non ho accesso|non riesco a|impossibile rispondere",
    "pt": r"não posso|não consigo|desculpe|lamento|não tenho acesso|sinto muito|não é possível responder|infelizmente não",
    "nl": r"kan (?:dit|deze|ik|hier|helaas|de|het)\b[^.]{0,40}\bniet|het spijt me|helaas niet|geen toegang",
    "sv": r"kan (?:inte|tyvärr)|jag är ledsen|tyvärr|beklagar",
    "da": r"kan (?:desværre )?ikke|beklager|desværre|ikkje svare",
    "pl": r"nie mogę|nie jestem w stanie|przykro mi|niestety|przepraszam",
    "cs": r"nemohu|nemůžu|bohužel|omlouvám|je mi líto|nedokážu",
    "tr": r"üzgünüm|cevap veremem|cevaplayamam|yanıtlayamam|yanıtlayamıyorum|cevaplayamıyorum|maalesef|göremiyorum|veremiyorum",
    "ro": r"nu pot|îmi pare rău|din păcate",
    "hu": r"nem tudok|nem tudom|sajnálom|sajnos",
    "fi": r"en voi|valitettavasti|en pysty|pahoittelen",
    "id": r"tidak (?:dapat|bisa)|maaf",
    "vi": r"xin lỗi|không thể|rất tiếc",
    "ru": r"не могу|к сожалению|извините|простите|не удалось|не удаётся|не в состоянии|невозможно",
    "uk": r"не можу|на жаль|вибачте",
    "el": r"δεν μπορώ|λυπάμαι|δυστυχώς",
    "zh": r"无法|抱歉|对不起|不能回答|無法|不能提供|看不到",
    "ja": r"できません|申し訳|お答えでき|わかりません|答えられ|ごめんなさい|見られません",
    "ko": r"죄송|수 없습니다|없어요|못합니다|어렵습니다",
    "ar": r"لا أستطيع|لا يمكنني|عذر|آسف|للأسف|غير قادر",
    "hi": r"माफ़|क्षमा|नहीं दे सकता|नहीं दे सकती|असमर्थ|खेद|नहीं सकता|नहीं देख",
    "he": r"לא יכול|מצטער|לצערי",
}
#: Frequent words by language, of grammar and of answering, none of what is seen; words that English uses as well are left out of the other lists.
WORDS = {
    "en": "the a an any of and to is are was were it that this these those there which what where how many far from with for in on at by as be been has have had i you we they he she or not no so but if then than its into does do did can would will should may must could more most some all both each first next again before after who only while under between above below near here my your our their them him her us me when why because about over out up down other also just very too yes answer option correct question see",
    "de": "der das den dem des dieser diese dieses diesem diesen ein eine einen einem einer und ist sind war nicht ich sich mit auf für von zu zur zum im am aus bei nach weil wenn dann noch nur auch wie wo wer welche welcher welches welchem oft man danach zuerst davon dazu daher darum also aber oder als dass es hier wird werden würde kann können keine kein über unter zwischen hinter neben vor gegenüber gibt sehen sieht steht stehen liegt befindet befinden insgesamt etwa beide zwei drei vier fünf sechs sieben acht neun zehn antwort richtige links rechts hinten vorne da",
    "fr": "le la les des du une un et est sont était ne pas je il elle ils elles nous vous on se ce cette ces mais plus ou où que qui quoi dont donc car puis avec sans sur sous dans pour par vers chez entre avant après devant derrière aux au deux trois quatre cinq six sept huit neuf dix réponse bonne correcte parce ensuite c'est n'est l'option aucun doute toujours peut fait voit trouve gauche droite",
    "es": "el la los las un una unos unas y es son era está están no se yo lo le con en por para que qué cuál dónde cuándo porque pero más muy del al entre sin sobre hasta desde hay luego primero después entonces también creo veo opción respuesta correcta detrás delante izquierda derecha dos tres cuatro cinco seis siete ocho nueve diez total",
    "it": "il lo la gli le i un uno una e è sono era non si io ci mi ti con in per che chi cosa dove quando perché ma più del della dei delle al alla nel nella nelle sul sulla dal dalla tra fra poi prima dopo quindi anche credo vedo vedono opzione risposta giusta corretta dietro davanti sinistra destra due tre quattro cinque sei sette otto nove dieci",
    "pt": "o os as um uma uns umas e é são era está estão não se eu lhe com em por para que qual onde quando porque pois mas mais muito do da dos das ao à no na nos nas pelo pela entre sem sobre até desde há depois primeiro então também acho vejo fica opção resposta certa correta atrás frente esquerda direita deles delas dois três quatro cinco seis sete oito nove dez",
    "nl": "de het een en zijn was niet ik zich met op voor van te naar uit bij er om aan ook maar of als dat die dit deze dus want omdat eerst daarna dan nog wel geen staat staan ligt zie antwoord juiste goede achter naast tussen twee drie vier vijf zes zeven acht negen tien",
    "sv": "en ett och är var inte jag sig med på för av till från det den de som men om att så när hur där här också eftersom därför sedan först alla finns står rätt svar bakom framför vänster höger två tre fyra fem sex sju åtta nio tio",
    "da": "og er var ikke jeg sig med på til fra det den de som men om at så når hvor der her også fordi derfor derefter først alle findes står rigtige svar bag foran venstre højre to tre fire fem seks syv otte ni ti",
    "no": "og er var ikke jeg seg med på til fra det den de som men om at så når hvor der her også fordi derfor deretter først alle finnes står riktig svar bak foran venstre høyre to tre fire fem seks sju åtte ni ti",
    "pl": "i w z na do nie się jest są to że o po za od dla jak ale czy co tak lub przez przed przy pod nad ponieważ dlatego więc najpierw potem widać stoi odpowiedź poprawna prawidłowa lewej prawej sztuk dwa trzy cztery pięć sześć siedem osiem dziewięć dziesięć",
    "cs": "a v z na do ne se je jsou to že o po za od pro jak ale co tak nebo před při pod nad protože proto tedy nejdřív potom vidět stojí správná odpověď vlevo vpravo dva tři čtyři pět šest sedm osm devět deset",
    "sk": "a v z na do nie sa je sú to že o po za od pre ako ale čo tak alebo pred pri pod nad pretože preto teda najprv potom vidieť stojí správna odpoveď vľavo vpravo dva tri štyri päť šesť sedem osem deväť desať",
    "tr": "ve bir bu şu o da de ki ne için ile ama gibi daha çok en var yok mi mı değil çünkü önce sonra olarak olan toplam tane görünüyor doğru cevap sol sağ iki üç dört beş altı yedi sekiz dokuz on",
    "vi": "là và của có không được cho với trong trên ở tại này đó các những một vì nên nhưng thì mà ra vào đáp án đúng bên trái phải trước sau tôi thấy hai ba bốn năm sáu bảy tám chín mười",
    "ro": "și este sunt nu se cu pe pentru din la de un o în că mai dar sau care ce unde deoarece răspunsul corect stânga dreapta două trei patru cinci",
    "hu": "a az és van nem hogy mert egy ez is de ha meg csak már mint vagy volt helyes válasz két három négy öt",
    "fi": "ja on ei se että koska oli ovat mutta kun tai myös niin joka oikea vastaus kaksi kolme neljä viisi",
    "id": "dan yang di ke dari itu ini untuk dengan tidak ada adalah karena pada juga atau jawaban benar dua tiga empat lima",
}
_EN = frozenset(WORDS["en"].split())
_SETS = {k: frozenset(v.split()) - (_EN if k != "en" else frozenset()) for k, v in WORDS.items()}
_FOREIGN = frozenset().union(*(v for k, v in _SETS.items() if k != "en"))
_SCRIPTS = {
    "cyrl": re.compile(r"[Ѐ-ӿ]"), "hani": re.compile(r"[㐀-鿿]"), "kana": re.compile(r"[぀-ヿ]"), "hang": re.compile(r"[가-힯]"),
    "arab": re.compile(r"[؀-ۿ]"), "deva": re.compile(r"[ऀ-ॿ]"), "grek": re.compile(r"[Ͱ-Ͽ]"), "hebr": re.compile(r"[֐-׿]"), "thai": re.compile(r"[฀-๿]"),
}
_NON_LATIN = re.compile(r"[Ѐ-ӿͰ-Ͽ֐-׿؀-ۿऀ-ॿ฀-๿぀-ヿ㐀-鿿가-힯]")


@lru_cache(maxsize=100_000)
def language(text: str, least: float = 0.3) -> str | None:
    """The language of a text of which at least that share are frequent words, or None if it holds too little to tell."""
    if _NON_LATIN.search(text):
        n, script = max((len(r.findall(text)), k) for k, r in _SCRIPTS.items())
        if n >= 3 and n >= 0.3 * len(_LETTERS.findall(text)):
            return {"cyrl": "ru", "hani": "ja" if _SCRIPTS["kana"].search(text) else "zh", "kana": "ja", "hang": "ko", "arab": "ar", "deva": "hi", "grek": "el", "hebr": "he", "thai": "th"}[script]
    words = _WORDS.findall(text.lower())
    if len(words) < 2:
        return None
    en = sum(w in _SETS["en"] for w in words)
    n, best = max((sum(w in s for w in words), k) for k, s in _SETS.items() if k != "en")
    if n >= 2 and n > en and n >= least * len(words):
        return best
    return "en" if en >= 2 and en > n else None


@lru_cache(maxsize=4)
def final_answer(text: str) -> str:
    """The text of a response outside its reasoning: the answer tag's body if there is one, else what follows the closed blocks."""
    if "<" not in text:
        return text
    m = _ANSWER.search(text)
    return m.group(1) if m else _TAGS.sub("", _THINK.sub("", text))


_UNSEEN = re.compile(f"[{ts.INVISIBLE}]+")


def is_empty(text: str | None) -> bool:
    """Nothing but blanks, invisible characters, tags or a placeholder, in the closed answer tag's body if there is one, whatever the length."""
    if text is None:
        return True
    bare = text if text.isascii() else _UNSEEN.sub("", text)
    if "<" in bare:
        m = _ANSWER.search(bare)
        bare = m.group(1) if m else _TAGS.sub("", bare)
    bare = bare.strip().strip("\"'`*").strip().lower().replace(" ", "_")
    return not bare or bare in PLACEHOLDERS or bare.rstrip(".") in PLACEHOLDERS


#: Alternatives that a run of literals may fan out into.
_FAN = 200


def spelled(items) -> set[str] | None:
    """All strings that a parsed pattern matches, None if they are many."""
    out = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            nexts = {chr(arg)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            nexts = {chr(c) for _, c in arg}
        elif name == "SUBPATTERN":
            nexts = spelled(arg[3])
        elif name == "BRANCH":
            each = [spelled(b) for b in arg[1]]
            nexts = None if None in each else set().union(*each)
        elif name == "MAX_REPEAT" and arg[1] == 1:
            nexts = spelled(arg[2])
            nexts = nexts and nexts | {""}
        else:
            return None
        if nexts is None or len(out) * len(nexts) > _FAN:
            return None
        out = {x + y for x in out for y in nexts}
    return out


def required(items) -> set[str]:
    """Literal strings one of which every match of a parsed pattern holds; of several such sets the one whose shortest string is longest."""
    sets, run = [], {""}
    for item in [*items, (None, None)]:
        op, arg = item
        nexts = op and spelled([item])
        if nexts and len(run) * len(nexts) <= _FAN:
            run = {x + y for x in run for y in nexts}
            continue
        sets.append(run - {""} if "" not in run else set())
        run = nexts or {""}
        if str(op) == "SUBPATTERN":
            sets.append(required(arg[3]))
        elif str(op) == "BRANCH":
            each = [required(b) for b in arg[1]]
            sets.append(set().union(*each) if all(each) else set())
        elif str(op) == "MAX_REPEAT" and arg[0]:
            sets.append(required(arg[2]))
    return max(sets, key=lambda x: min(map(len, x), default=0), default=set())


def alternatives(pattern: str) -> list[str]:
    """A pattern cut at its outermost bars."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(pattern):
        depth += (ch in "([") - (ch in ")]")
        if ch == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
    return [*out, pattern[at:]]


@cache
def _refusals() -> tuple[ahocorasick.Automaton, list[re.Pattern]]:
    """An automaton of literal strings one of which every phrase holds, with the numbers of their phrases; and the phrases."""
    phrases = [x for pattern in REFUSALS.values() for x in alternatives(pattern)]
    holders: dict[str, list[int]] = {}
    for i, phrase in enumerate(phrases):
        for w in required(list(re._parser.parse(phrase))):
            holders.setdefault(w, []).append(i)
    a = ahocorasick.Automaton()
    for w, numbers in holders.items():
        a.add_word(w, tuple(numbers))
    a.make_automaton()
    return a, [re.compile(x) for x in phrases]


def is_refusal(text: str) -> bool:
    """A refusal phrase stands in the final answer; only phrases with a literal string that is there are tried."""
    low = final_answer(text).lower()
    low = low if low.isascii() else low.replace("’", "'")
    automaton, phrases = _refusals()
    tried = {numbers for _, numbers in automaton.iter(low)}
    return any(phrases[i].search(low) for i in set().union(*tried)) if tried else False


#: A response is a candidate for a copy if compressing it with its prompt leaves at most this share of its cost.
COPY_SHARE = 0.55
#: Bytes of a compressed frame without content.
_FRAME = 9
#: What may stand before a copied question.
LEADS = "you asked: question: the question is: q: options: choices: frage: optionen: my question: user: prompt: problem: "
_LEAD = re.compile(r"\b(?:you asked|question|the question is|q|options?|choices|frage|optionen|my question|user|prompt|problem)\b")
_OPTION_LINE = re.compile(r"(?m)^\s*[A-Ha-h][.):]\s+.*$")


@cache
def _parameters(bits: int) -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters.from_level(3, source_size=1 << bits, dict_size=1 << bits, write_content_size=0)


@cache
def _alone(bits: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(compression_params=_parameters(bits))


def copied_share(prompt: str, response: str) -> float:
    """Size of the response compressed with the prompt as dictionary, as a share of its size compressed alone; the window holds both whole."""
    p, r = (LEADS + prompt).encode("utf-8", "replace"), response.encode("utf-8", "replace")
    bits = max(8, (len(p) + len(r)).bit_length())
    d = zstandard.ZstdCompressionDict(p, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    with_prompt = len(zstandard.ZstdCompressor(dict_data=d, compression_params=_parameters(bits)).compress(r))
    return max(0, with_prompt - _FRAME) / max(1, len(_alone(bits).compress(r)) - _FRAME)


def _plain(s: str) -> str:
    return _MARKS.sub(" ", s.lower()).strip()


def _slip(a: str, b: str) -> bool:
    return not any(c.isdigit() for c in a + b) and min(len(a), len(b)) > 2 and edits(a, b) <= (2 if len(a) >= 8 else 1)


def adds_nothing(question: str, options: list[str], body: str, with_lines: bool) -> bool:
    """No word is left of a response without its question, its options and lead-ins; two or a fifth of the question's words may hold slips, an eighth be missing."""
    whole = lambda s: re.compile(rf"(?<!\w){re.escape(s)}(?!\w)")
    if whole(question).search(body):
        rest = whole(question).sub(" ", body)
        for o in [] if with_lines else options:
            rest = whole(o).sub(" ", rest) if len(o) > 2 else rest
        return not _LEAD.sub(" ", rest).strip()
    asked, said = question.split(), _LEAD.sub(" ", body).split()
    listed = set() if with_lines else {w for o in options for w in o.split()}
    slips = missing = 0
    for op, i, j, k, m in difflib.SequenceMatcher(None, asked, said, autojunk=False).get_opcodes():
        if op == "replace" and j - i == m - k and all(_slip(x, y) for x, y in zip(asked[i:j], said[k:m])):
            slips += j - i
        elif op == "delete" and not any(c.isdigit() for w in asked[i:j] for c in w):
            missing += j - i
        elif op != "equal" and not (op == "insert" and listed.issuperset(said[k:m])):
            return False
    return slips <= max(2, len(asked) // 5) and missing <= len(asked) // 8


def is_copy(question: str | None, options: list[str] | None, response: str) -> bool:
    """The response says nothing but its question, or question and options."""
    if not question or len(response) < (least := 0.6 * len(question.strip())):
        return False
    body = final_answer(response).strip()
    if len(body) < least or not (q := _plain(question)):
        return False
    with_lines = len(_OPTION_LINE.findall(body)) >= 2
    said = _plain(_OPTION_LINE.sub(" ", body) if with_lines else body)
    listed = [p for o in options or [] if o and (p := _plain(o))]
    return copied_share(" ".join([*listed, q]), said) <= COPY_SHARE and adds_nothing(q, listed, said, with_lines)


@lru_cache(maxsize=50_000)
def asked_language(question: str | None) -> str:
    """The language of a question, English where nothing tells."""
    if not question or question.isascii() and _FOREIGN.isdisjoint(question.lower().split()):
        return "en"
    return language(question, 0.15) or "en"


_PARTS = re.compile(r"(?<=[.!?。！？।])\s+|</?[a-zA-Z]\w*>|\n")


def is_foreign(question: str | None, response: str) -> bool:
    """A sentence of the response is in a language other than the question's; quoted words don't count."""
    asked = asked_language(question)
    if asked == "en" and (response.isascii() or not _NON_LATIN.search(response)) and _FOREIGN.isdisjoint(response.lower().split()):
        return False
    for part in _PARTS.split(_QUOTED.sub(" ", response)):
        got = language(part) if part else None
        if got and got != asked:
            return True
    return False


def label(columns: dict[str, list]) -> list[tuple]:
    """Rows of kind `defect` for the pairs of a batch, the defect in column w."""
    out = []
    for tab, row_id, q, opts, text in zip(*(columns[c] for c in ("tab", "row_id", "question", "options", "text"))):
        if row_id is None:
            continue
        defect = "empty" if is_empty(text) else "refusal" if is_refusal(text) else "copy" if is_copy(q, opts, text) else "language" if is_foreign(q, text) else None
        if defect:
            out.append(("defect", tab, row_id, None, None, defect, 0, 0))
    return out


def find_defects(pairs: DataFrame) -> DataFrame:
    """Rows (tab, row_id, defect) of `pairs` (tab, row_id bigint, run string, question, options array<string>, text).

    A null text is `empty`; a null question can have neither a copy nor another language than English;
    null row ids give no row; repeated rows give one. Empty tables give an empty result; further columns are
    ignored.
    """
    narrow = pairs.select("tab", "row_id", "run", "question", "options", "text")
    seen = truncation.scanned(narrow, label)
    cuts = truncation.find_truncated(narrow, seen).select("tab", "row_id").withColumn("w", F.lit("truncated"))
    # a pair's one defect: the first in this order
    rank = F.expr(f"array_position(array({', '.join(repr(d) for d in ORDER)}), w)")
    both = seen.where("kind = 'defect'").select("tab", "row_id", "w").unionByName(cuts)
    return both.groupBy("tab", "row_id").agg(F.min_by("w", rank).alias("defect"))
