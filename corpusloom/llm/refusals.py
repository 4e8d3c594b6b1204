"""Refusals, by aligning sentences with templates of slots.

A template is a row of slots; a slot holds phrases that may stand in it, so a template covers what its phrases can be
combined to, not one sentence. A sentence aligns if the slots come in order with few words between them, and if most of
its words are the templates' own, common function words or words of the prompt (what the refusal is about).
A response is a refusal if every sentence but courtesies is. Templates are about someone who answers or about the given
material; what a method, model or layer cannot do is no refusal.
"""

from __future__ import annotations

import re

from corpusloom.llm.language_id import fold
from corpusloom.llm.wordlists import FUNCTION_WORDS

#: Least share of a sentence's words that the alignment accounts for; most words of a sentence.
REFUSAL_SHARE, MOST_WORDS = 0.6, 40

#: Phrases by slot, folded; "|" parts phrases.
SLOTS = {
    # English
    "me": "i|i'm|i am|i'd|i've",
    "i": "i|i'm|i am|i'd|i'll|i've|we|we're|we are|this assistant|the assistant",
    "cannot": "can't|cannot|can not|cant|could not|couldn't|won't|will not|would not|wouldn't|am not able to|not able to|unable to|not allowed to|not permitted to|not authorised to|not authorized to|not in a position to|not going to|must decline to|decline to|refuse to|have to decline to|prefer not to|would rather not|rather not|not comfortable|don't want to|do not want to|not supposed to|not qualified to",
    "tell": "answer|answering|help|assist|say|tell|respond|reply|comment|provide|give|offer|discuss|share|explain|address|determine|speculate|guess|judge|verify|confirm|talk|speak|do|support|resolve|fulfil|complete|find|express|opine|elaborate|be of help",
    "not": "don't|do not|dont|didn't|did not|haven't|have not|have no|have got no|hardly|never",
    "know": "know|know the answer|have|recall|remember|understand|idea|clue|answer|information|knowledge|find|access|see|any idea|got|opinion|details|data",
    "lack": "no|not enough|isn't enough|insufficient|not sufficient|too little|lack|lacking|without|not any|aren't any|isn't any",
    "fact": "information|answer|context|data|evidence|detail|details|comment|response|idea|clue|knowledge|mention|basis|material|opinion",
    "source": "context|passage|passages|excerpt|excerpts|document|documents|material|materials|lecture|lectures|transcript|transcripts|source|sources|text|slides|notes|snippet|snippets|retrieved|provided|course",
    "omits": "not|doesn't|does not|don't|do not|didn't|did not|isn't|is not|aren't|never|no|nothing|neither|fails to|fail to|lacks|lack|silent",
    "hold": "mention|mentions|mentioned|contain|contains|cover|covers|covered|address|addresses|say|says|said|include|includes|provide|provides|discuss|discusses|information|answer|specify|state|states|about|tell|tells|given|describe|on this|enough|explain|allow|let me",
    "beyond": "outside|beyond|out of|exceeds|above|not within|not part of|not something",
    "scope": "scope|knowledge|expertise|remit|what i|abilities|ability|capabilities|area|reach|competence|field|i can|i'm allowed|i am allowed|my|limits",
    "ask": "ask|asking|consult|contact|refer|check with|reach out|speak to|talk to|try",
    "other": "someone|somebody|else|instructor|teacher|teaching|staff|lecturer|professor|tutor|expert|another|elsewhere|something|different question|support",
    "unsure": "not sure|unsure|not certain|uncertain|hard to say|difficult to say|impossible to say|impossible for me|not possible for me|no way to know|who knows|beats me|your guess is as good as mine|no comment|no idea|no clue|leave the question open|leave this open|leave that open|leave it open|leave this unanswered|pass on this|skip this|not guess|decline|refuse",
    # Vietnamese, as typed without accents
    "toi": "toi|minh|em|chung toi|tui|tro ly|chung minh|ban|anh|chi",
    "khong": "khong|chua|chang|khong the|khong duoc|khong duoc phep|chua the|tu choi|xin phep|xin phep khong|khong du|khong dam|khong muon|khong tien|xin duoc khong|khong co kha nang|khong ho tro|chiu",
    "noi": "biet|tra loi|giup|ho tro|noi|dua ra|cung cap|giai dap|ro|chac|tim thay|phep|ban luan|ban ve|doan|cho biet|dap an|thong tin|du lieu|y kien|cau tra loi|can cu|co so|bo qua|giai thich|ket luan|nhan xet|tiet lo|lam|dap ung",
    "nguon": "tai lieu|ngu canh|doan trich|noi dung|bai giang|van ban|nguon|phan trich|boi canh|doan van|du lieu|trich doan|tu lieu|thong tin",
    "vang": "khong|chua|chang|khong he|thieu|khong co|chua co|khong du",
    "co": "de cap|nhac|nhac den|noi|co|du|cung cap|chua|thong tin|neu|cho biet|trinh bay|tra loi|giai thich|nhac toi|ban|du de",
    "ngoai": "ngoai|vuot|vuot qua|nam ngoai|khong thuoc|vuot ngoai",
    "pham": "pham vi|kha nang|hieu biet|linh vuc|chuyen mon|kien thuc|tam|quyen|chuc nang",
    "hoi": "hoi|lien he|tham khao|trao doi voi",
    "nguoi": "giang vien|tro giang|thay|co giao|nguoi khac|chuyen gia|cau khac|cau hoi khac|giao vien|ban khac|bo phan",
    # French
    "je": "je|j'|nous|on|m'|l'assistant|me",
    "nepas": "ne peux pas|ne peux|ne pouvons pas|ne puis|ne saurais|ne suis pas en mesure de|ne suis pas en mesure d'|ne suis pas autorise a|ne suis pas capable de|pas le droit de|prefere ne pas|prefere ne|refuse de|dois refuser de|regrette de ne pas|pas habilite a|incapable de|impossible de|ne vais pas|ne veux pas|ne souhaite pas|ne pourrai pas|ne pourrais pas|dois decliner|decline|m'abstenir de",
    "dire": "repondre|reponds|aider|dire|donner|fournir|prononcer|commenter|parler|discuter|expliquer|me prononcer|renseigner|preciser|traiter|trouver|affirmer|deviner|confirmer|cette question|faire|y repondre",
    "sais": "ne sais pas|n'en sais rien|ne sais|n'ai pas|n'ai aucune|n'en ai aucune|n'en ai pas|ignore|ne connais pas|ne dispose pas|ne dispose d'aucune|ne trouve pas|n'ai rien|n'ai trouve|n'ai pas trouve|ne possede pas|n'avons pas|aucune|pas assez|manque|ne vois pas|ne me souviens pas",
    "chose": "reponse|idee|information|informations|renseignement|element|elements|connaissance|avis|opinion|donnees|contexte|acces|rien|la|trouve|details|commentaire|repondre",
    "texte": "contexte|extrait|extraits|passage|passages|document|documents|texte|textes|cours|source|sources|transcription|fournis|notes|support",
    "muet": "ne|n'|aucun|aucune|rien|pas|sans|insuffisant|muet",
    "dit": "dit|mentionne|mentionnent|contient|contiennent|parle|parlent|permet|permettent|aborde|abordent|precise|precisent|fournit|fournissent|information|repond|traite|evoque|indique|donne|suffit|suffisent|explique",
    "hors": "depasse|hors de|hors|en dehors de|au-dela de|sort de|dehors|dehors de",
    "portee": "competences|competence|connaissances|portee|domaine|perimetre|cadre|ce que je|mes|mon|champ",
    "demandez": "demandez|adressez|consultez|contactez|posez|voyez|tournez|demander",
    "autre": "enseignant|professeur|assistant|equipe|quelqu'un|autre|expert|charge de cours|ailleurs|formateur|responsable",
    # German
    "ich": "ich|wir|mir|uns|der assistent",
    "nicht": "nicht|nichts|leider nicht|keine|kein|lieber nicht|nicht in der lage|nicht befugt|nicht berechtigt|ungern|verweigere|lehne|muss ablehnen|darf nicht|kann nicht|unmoglich|weder",
    "sagen": "beantworten|antworten|sagen|helfen|auskunft|antwort|geben|wissen|weiss|weiss es|aussern|stellung|mitteilen|erklaren|beurteilen|finden|sprechen|informationen|information|angaben|ahnung|kommentieren|dienen|ab|raten|spekulieren|machen|liefern|bestatigen|meinung|kommentar|bekannt|tun|nennen",
    "quelle": "kontext|auszug|auszuge|auszugen|dokument|dokumente|text|texte|unterlagen|vorlesung|quelle|quellen|material|transkript|abschnitt|abschnitte|passagen|folien|skript|ausschnitte",
    "fehlt": "keine|kein|nicht|nichts|ohne|fehlt|fehlen|zu wenig|unzureichend|nirgends",
    "steht": "sagt|sagen|enthalt|enthalten|erwahnt|erwahnen|information|informationen|angaben|dazu|hinweis|behandelt|behandeln|hervor|geht|gibt|reicht|reichen|genug|antwort|beschreibt|davon|daruber|nennt",
    "keine": "keine ahnung|weiss nicht|weiss ich nicht|weiss das nicht|weiss es nicht|keine angabe|keine angaben|kein kommentar|nicht bekannt|unbekannt|uberfragt|passe|nicht sicher|unsicher|fehlen mir|fehlt mir|liegen mir keine|liegen uns keine|ist mir nicht|offen lassen|keine antwort|keine informationen|keine auskunft|keine information",
    "ausser": "ausserhalb|ubersteigt|uber|jenseits|nicht in|gehort nicht",
    "bereich": "wissens|kenntnisse|kompetenz|bereichs|zustandigkeit|moglichkeiten|fahigkeiten|bereich|rahmen|wissen|meines|meiner|meine",
    "frag": "fragen|fragen sie|frag|wenden|wende|kontaktieren|konsultieren|sprechen sie|erkundigen",
    "wen": "dozenten|dozent|lehrkraft|lehrer|jemand|jemanden|andere|anderen|professor|tutor|experten|betreuer|team|anderes|kursleitung|dozierenden",
    # Spanish
    "yo": "yo|no|me|lo siento|nosotros|lamento|temo",
    "nopuedo": "no puedo|no podemos|no podria|no soy capaz de|no estoy autorizado a|no estoy autorizada a|no me es posible|no me corresponde|no tengo permiso para|no tengo permitido|prefiero no|me niego a|debo rechazar|no quiero|imposible|no es posible|no voy a|no estoy en condiciones de|no se me permite|me abstengo de|no sabria|no consigo|no debo",
    "decir": "responder|contestar|ayudar|ayudarte|decir|decirle|decirte|dar|opinar|comentar|hablar|ofrecer|proporcionar|explicar|responderte|responderle|contestarte|discutir|aclarar|tratar|facilitar|encontrar|adivinar|confirmar|hacerlo|especular|pronunciarme|ayudarle",
    "nose": "no se|no lo se|no tengo|no dispongo|no cuento|no conozco|desconozco|ignoro|no sabemos|no tenemos|no encuentro|no recuerdo|no hay|falta|no existe|no sabria|no encontre|ni idea|sin",
    "cosa": "respuesta|idea|informacion|datos|conocimiento|elementos|opinion|acceso|contexto|detalles|lo|la|ni|suficiente|suficientes|pregunta|comentario|comentarios|se|nada",
    "fuente": "contexto|fragmento|fragmentos|documento|documentos|texto|textos|material|materiales|clase|fuente|fuentes|transcripcion|pasajes|apuntes|extracto|extractos|curso",
    "calla": "no|nada|ningun|ninguna|sin|tampoco|insuficiente",
    "dice": "dice|dicen|menciona|mencionan|contiene|contienen|habla|hablan|permite|permiten|aborda|abordan|incluye|incluyen|trata|informacion|responde|ofrece|explica|indica|da|basta|aclara|cubre|aporta|aportan",
    "fuera": "fuera de|mas alla de|excede|supera|no entra en|escapa",
    "alcance": "alcance|conocimientos|conocimiento|competencia|competencias|ambito|mi|mis|lo que|area|capacidades|posibilidades",
    "pregunte": "pregunte|pregunta|preguntale|consulte|consulta|contacte|contacta|dirijase|acude|acuda|hable con",
    "otro": "profesor|profesora|docente|docentes|alguien|otra|otro|experto|tutor|equipo|instructor|personal",
}

#: Templates: slots in order; the number is the most words between one slot and the next.
TEMPLATES = [
    ("i cannot tell", 3), ("me not know", 3), ("lack fact", 3), ("source omits hold", 4), ("omits hold source", 4), ("beyond scope", 3), ("ask other", 4), ("unsure", 0), ("cannot tell source", 5), ("i lack fact", 3),
    ("toi khong noi", 4), ("khong noi", 1), ("nguon vang co", 5), ("ngoai pham", 3), ("hoi nguoi", 3),
    ("je nepas dire", 4), ("nepas dire", 2), ("je sais", 1), ("sais chose", 3), ("texte muet dit", 4), ("muet dit texte", 5), ("hors portee", 3), ("demandez autre", 4), ("texte sais chose", 4),
    ("ich nicht sagen", 6), ("sagen ich nicht", 4), ("nicht ich sagen", 6), ("keine", 0), ("quelle fehlt steht", 5), ("quelle steht fehlt", 4), ("fehlt steht quelle", 5), ("ausser bereich", 3), ("frag wen", 5),
    ("nopuedo decir", 4), ("nose cosa", 4), ("nose", 0), ("fuente calla dice", 4), ("calla dice fuente", 5), ("fuera alcance", 3), ("pregunte otro", 4),
]
#: How courtesies begin, folded, as words; a single word is one only in a short sentence.
COURTESIES = "good question|great question|that is a good question|that's a good question|thank you|thanks|cau hoi rat hay|cau hoi hay|cam on|bonne question|merci|gute frage|danke|vielen dank|buena pregunta|gracias|hello|hi|hey|dear|xin chao|chao|bonjour|salut|hallo|hola|sorry|i'm sorry|i apologize|my apologies|unfortunately|xin loi|rat tiec|mong ban thong cam|desole|je suis desole|je regrette|leider|es tut mir leid|tut mir leid|entschuldigung|lo siento|lo lamento|lamentablemente|disculpe|perdon"
_PLAIN = re.compile(r"[^\w']+|_+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_COURTESY = re.compile(rf"(?:{COURTESIES})(?= |$)")


def plain(text: str) -> list[str]:
    """Words in lower case without accents or signs."""
    return _PLAIN.sub(" ", fold(text.lower().replace("’", "'").replace("ß", "ss"))).split()


def _slot(name: str) -> str:
    return "(?:" + "|".join(sorted(map(re.escape, SLOTS[name].split("|")), key=len, reverse=True)) + ")"


def _template(slots: str, gap: int) -> str:
    return f"(?: [^ ]+){{0,{gap}}}? ".join(_slot(s) for s in slots.split()) + "(?= |$)"


_ANY = re.compile(r"(?:^|(?<= )|(?<=l'|d'|j'|n'|m'))(?:" + "|".join(_template(s, g) for s, g in TEMPLATES) + ")")
_OWN = frozenset(w for phrases in SLOTS.values() for p in phrases.split("|") for w in p.split()) | frozenset(w for ws in FUNCTION_WORDS.values() for x in ws for w in plain(x)) | frozenset(w for p in COURTESIES.split("|") for w in p.split())
#: What refusals name themselves by, folded.
_OWN |= frozenset("question questions topic subject matter request afraid honestly currently present moment point based available specific relevant cau hoi van de nay chuyen thac mac sujet pregunta tema asunto frage thema anfrage momentan derzeit actualmente esta esto eso das dies darauf dazu daruber hierzu thi hon nhe a roi hien tai ai language model".split())


#: Words that may come before the template begins, folded: who or what else is spoken of is then no subject of it.
_BEFORE = frozenset(
    """sorry but so well honestly unfortunately regrettably apologies afraid i'm i am and as an ai a language model assistant virtual that this is it's that's it the your for question on to about of such matter topic at this point
    moment currently from these those given in there no here's with respect all fear must say my thank you thanks good great my apologies apologize based falls fall lies goes would rather one please you should unable
    xin loi rat tiec thanh that thuc ra thu that hien tai ve voi doi cau hoi nay van de dieu chuyen noi dung thi la mot tro ly ai toi minh em a da nen tot nhat vang tiec rang rang do vi theo cau chu de nhung ban oi cam on hay
    desole malheureusement je suis regrette mais en tant qu qu' que cette ce cela sur pour la question il navre honnetement pardon c'est a ce sujet l' assistant une ia me merci bonne de d' les le m'est m'etait serait veuillez vous devriez
    leider es tut mir leid aber als ki dazu das die diese dieser frage zu hierzu daruber entschuldigung ehrlich gesagt da auf dieses thema darf muss ich bedaure gute danke fur assistent ein nun ja der den dem liegt fallt ware bitte sie sollten
    lo siento lamento lamentablemente pero como una ia asistente la el sobre esta este eso esa pregunta para disculpe perdon honestamente me temo que a ese respecto de desgraciadamente gracias por buena por desgracia queda esta cae seria debe deberia los las""".split()
)


def is_refusal_sentence(words: list[str], topic: frozenset[str] = frozenset()) -> bool:
    """Whether a sentence (words of :func:`plain`) aligns with a template; ``topic`` are the prompt's words."""
    text = " ".join(words)
    m = _ANY.search(text) if words and len(words) <= MOST_WORDS else None
    if not m or not all(w in _BEFORE for w in text[: m.start()].split()):
        return False
    known = sum(w in _OWN or w in topic or ("'" in w and all(p in _OWN or len(p) == 1 for p in w.split("'") if p)) for w in words)
    return known >= REFUSAL_SHARE * len(words)


def is_courtesy(words: list[str]) -> bool:
    m = _COURTESY.match(" ".join(words))
    return bool(m) and len(words) <= (4 if " " not in m.group() else 14) + m.group().count(" ")


def is_refusal(answer: str, topic: frozenset[str] = frozenset()) -> bool:
    """Whether every sentence but courtesies is a refusal, and one is."""
    seen = False
    for s in _SENTENCE.split(answer):
        w = plain(s)
        if not w or is_courtesy(w) and not is_refusal_sentence(w, topic):
            continue
        if not is_refusal_sentence(w, topic):
            return False
        seen = True
    return seen
