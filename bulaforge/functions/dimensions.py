"""Fixed values of the domain: species, topics, forms and their keyword lists.

They are small constants (far below a hundred rows each) and enter plans as literals or
broadcast dimensions. Order matters where a first match decides.
"""

from __future__ import annotations

# Canonical species and their synonyms, in order of precedence.
SPECIES = [
    ("suínos", ["suíno", "suino", "suínos", "suinos", "porco", "porcos", "leitão", "leitões", "porcino"]),
    ("bovinos", ["bovino", "bovinos", "vaca", "vacas", "novilho", "novilhos", "touro", "touros", "bezerro", "bezerros", "gado"]),
    ("equinos", ["cavalo", "cavalos", "égua", "éguas", "egua", "eguas", "potro", "potros", "equino", "equinos"]),
    ("cães", ["cão", "cao", "cães", "caes", "cachorro", "cachorros", "cadela", "cadelas", "canino", "caninos"]),
    ("gatos", ["gato", "gatos", "gata", "gatas", "felino", "felinos", "gatinho", "gatinhos"]),
    ("ovinos", ["ovino", "ovinos", "ovelha", "ovelhas", "carneiro", "carneiros", "borrego", "borregos", "cordeiro", "cordeiros"]),
    ("caprinos", ["caprino", "caprinos", "cabra", "cabras", "bode", "bodes"]),
    ("aves", ["ave", "aves", "galinha", "galinhas", "frango", "frangos"]),
    ("perus", ["peru", "perus"]),
    ("coelhos", ["coelho", "coelhos", "coelha", "coelhas", "leporídeo", "leporídeos", "leporideo", "leporideos"]),
]

# Topic, keywords, target section numbers; the first topic with a keyword wins.
TOPICS = [
    ("dose", ["dose", "dosagem", "posologia", "quanto administrar"], ["4.9", "4.2"]),
    ("armazenamento", ["armazenamento", "armazenar", "armazenado", "conservar", "conservação", "guardar", "validade"], ["6.4", "6.3"]),
    ("administracao", ["administração", "administrar", "via de administração", "como usar", "forma de administração"], ["4.9"]),
    ("composicao", ["composição", "princípio ativo", "principio ativo", "substância ativa", "substancia ativa", "componentes"], ["2.", "6.1"]),
    ("indicacao", ["indicação", "indicado", "usado para", "serve para", "para que serve", "utilização"], ["4.2"]),
    ("especies", ["espécies", "espécie", "espécies-alvo", "espécies alvo", "para que espécies"], ["4.1"]),
    ("reacoes", ["reações adversas", "efeitos colaterais", "efeitos indesejáveis", "reações"], ["4.6"]),
    ("intervalos", ["intervalos", "intervalo de segurança", "tempo de espera", "carência"], ["4.11"]),
    ("contraindicacoes", ["contraindicações", "contraindicação", "contra-indicações", "não deve ser usado"], ["4.3"]),
    ("receita", ["receita médica", "receita veterinária", "prescrição"], ["9.", "10."]),
    ("fabricante", ["fabricante", "laboratório", "titular"], ["7."]),
    ("apresentacao", ["apresentação", "embalagem", "forma farmacêutica"], ["3.", "6.5"]),
]
GENERAL = "geral"

# Words that find sections by content where no section number matches.
TOPIC_WORDS = {
    "dose": ["posologia", "dose", "administração"], "armazenamento": ["conservação", "armazenamento", "validade"],
    "especies": ["espécies", "alvo"], "composicao": ["composição"], "indicacao": ["indicação", "indicações"],
    "contraindicacoes": ["contra-indicação", "contraindicação"], "reacoes": ["reações", "efeitos"], "intervalos": ["intervalo", "espera", "carência"],
}
FORMS = ["comprimidos", "comprimido", "injetável", "injetavel", "solução", "solucao", "pó", "po", "pomada", "creme", "spray", "gotas"]

# Phrases that mark a comparison, and phrases about one product.
COMPARISON = [
    "alternativ", "substitut", "equivalente", "similar", "mesmo princípio ativo", "mesma substância", "que medicamentos", "quais medicamentos",
    "liste medicamentos", "medicamentos com", "medicamentos contendo", "medicamentos que", "marcas",
]
ONE_PRODUCT = [
    "qual a dose", "dose indicada", "como armazenar", "como deve ser armazenado", "armazenamento", "qual a forma de administração", "forma de administração",
    "quais os intervalos", "intervalos de segurança", "qual é a composição", "qual a composição", "composição do", "para que é usado", "para que serve",
    "que reações adversas", "reações adversas", "em que espécies pode ser usado", "para que espécies", "como deve ser administrado",
]
VAGUE = [
    "não encontrei", "não foi possível encontrar", "não há informação", "não consta", "não está especificado", "consulte o veterinário",
    "consulte a bula", "informação não encontrada",
]
SPECIFIC_UNITS = ["mg", "ml", "kg", "°c", "graus", "dias", "horas"]
SHORT_FOLLOW_UP = ["e", "para", "em", "gatos", "cães", "suínos", "bovinos", "equinos", "peru", "perus", "aves", "coelhos", "dose", "dosagem", "armazenamento", "composição", "indicação", "efeitos"]
NOT_A_PRODUCT = ["para", "com", "que", "qual", "como", "quais", "onde", "quando", "espécie", "espécies", "animal", "animais", "medicamento", "medicamentos", "dose", "dosagem", "porque", "porquê"]
# Opening of a rewritten question by topic.
FOLLOW_UP_OPENING = {
    "dose": "Qual a dose do ", "armazenamento": "Como armazenar o ", "composicao": "Qual a composição do ", "indicacao": "Para que serve o ",
    "reacoes": "Quais os efeitos adversos do ", "especies": "Para que espécies está indicado o ", "contraindicacoes": "Quais as contra-indicações do ",
    "intervalos": "Quais os intervalos de segurança do ",
}
# Frequent words by language, in order of precedence, and hints of Portuguese.
LANGUAGE_WORDS = [
    ("ingles", ["the", "this", "that", "these", "those", "and", "with", "for", "according", "document", "information", "dose", "administration", "storage", "species", "indicated", "should", "must", "following", "please", "refer", "consult"]),
    ("espanhol", ["el", "la", "los", "las", "según", "información", "está", "debe", "puede", "siguiente"]),
    ("frances", ["le", "les", "selon", "avec", "dans", "pour", "sur", "doit", "peut"]),
    ("alemao", ["der", "die", "das", "und", "mit", "nach", "für", "von", "auf", "sind"]),
]
PORTUGUESE_HINTS = ["o", "a", "os", "as", "de", "do", "da", "dos", "das", "em", "para", "com", "por", "que", "não", "é", "são", "está", "segundo", "medicamento", "dose", "espécie", "espécies", "armazenamento", "indicação", "deve"]
