"""Cue lists of the deadline, status and title rules."""

# Results depend on exactly these lists.

MONTHS = {
    "janeiro": 1, "jan": 1, "january": 1,
    "fevereiro": 2, "fev": 2, "february": 2, "feb": 2,
    "marco": 3, "mar": 3, "march": 3,
    "abril": 4, "abr": 4, "april": 4, "apr": 4,
    "maio": 5, "may": 5,
    "junho": 6, "jun": 6, "june": 6,
    "julho": 7, "jul": 7, "july": 7,
    "agosto": 8, "ago": 8, "august": 8, "aug": 8,
    "setembro": 9, "set": 9, "september": 9, "sep": 9, "sept": 9,
    "outubro": 10, "out": 10, "october": 10, "oct": 10,
    "novembro": 11, "nov": 11, "november": 11,
    "dezembro": 12, "dez": 12, "december": 12, "dec": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "mayo": 5, "junio": 6, "julio": 7,
    "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6,
    "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
}

DEADLINE = (
    "prazo", "inscricoes", "inscricao", "submissao", "submissoes", "data limite",
    "data de encerramento", "encerramento", "candidaturas", "deadline", "apply by",
    "applications close", "application deadline", "closing date", "submission deadline",
    "submit by", "open until", "fecha limite", "cierre", "convocatoria hasta", "candidature jusqu",
)
NOT_A_DEADLINE = (
    "publicado", "publicacao", "atualizado", "atualizacao", "lancamento",
    "inicio do projeto", "inicio dos projetos", "inicio da mobilidade", "funding starts",
    "start of funding", "selection decision", "resultado", "abertura das inscricoes",
    "previsao para abertura", "inscricoes abrem em", "applications open on", "opening date", "opens on",
)
OPENING_BEFORE = ("previsao para abertura", "abertura das inscricoes", "inscricoes abrem em", "applications open on", "opening date", "opens on")
OPEN = (
    "inscricoes abertas", "submissoes abertas", "candidaturas abertas", "em andamento",
    "aberto para submissao", "prazo aberto", "apply now", "applications open", "open call",
    "call open", "status em andamento", "status: open", "status open", "open for applications",
)
CLOSED = (
    "inscricoes encerradas", "inscricoes fechadas", "candidaturas encerradas", "chamada encerrada",
    "edital encerrado", "status finalizado", "finalizado", "closed", "expired",
    "applications closed", "call closed", "deadline passed",
)
FORTHCOMING = (
    "status: forthcoming", "status forthcoming", "forthcoming call", "call forthcoming",
    "applications forthcoming", "opening soon", "abre em", "abrira em", "abertura prevista", "chamada futura",
)
RESULT = ("resultado final", "resultado preliminar", "lista de selecionados", "homologacao do resultado", "resultado da chamada")
PUBLIC_ONLY = (
    r"somente\s+(?:as\s+)?(?:instituicoes|universidades|ies)\s+publicas",
    r"exclusiv\w*\s+para\s+(?:instituicoes|universidades|ies)\s+publicas",
    r"apenas\s+(?:instituicoes|universidades|ies)\s+publicas",
    r"public\s+universit(?:y|ies)\s+only",
)
INBOUND = (
    r"estudantes?\s+internacionais?.{0,100}(?:estudar|cursar|pos-graduacao).{0,80}no\s+brasil",
    r"estrangeiros?.{0,100}(?:estudar|cursar).{0,80}no\s+brasil",
    r"foreign\s+students?.{0,100}(?:study|degree).{0,80}(?:in|at)\s+brazil",
    r"incoming\s+(?:mobility|students?).{0,100}brazil",
)
OUTBOUND = (
    "do brasil para", "brasil para", "pesquisadores do brasil", "no exterior", "abroad", "outgoing",
    "from brazil", "brasil e", "brazil and", "brazil-", "parceria", "partnership", "cooperacao",
    "collaboration", "consorcio",
)
LOCAL = ("brasil", "brazil", "brasileir", "brazilian", "espirito santo", "fapes", "confap", "cnpq", "capes")
ANCHORS = (
    "parceria", "partnership", "cooperacao", "collaboration", "joint research", "research collaboration",
    "pesquisa", "research", "grant", "funding", "bolsa", "fellowship", "chamada", "call for", "edital",
    "university", "universidade", "higher education institution", "researcher mobility",
    "student mobility", "study abroad",
)
EMPTY_WORDS = (
    "de", "da", "do", "das", "dos", "e", "o", "a", "os", "as", "em", "para", "com", "no", "na", "nos",
    "nas", "por", "ao", "aos", "the", "of", "and", "for", "in", "publicacao", "chamada", "edital",
    "programa", "diretrizes", "aviso", "call", "n", "alteracao", "retificacao",
)
GENERIC_LABELS = (
    "baixar", "download", "download aqui", "clique aqui", "clique", "acesse", "acesso", "abrir", "ver",
    "veja", "visualizar", "consultar", "leia mais", "saiba mais", "mais informacoes", "anexo", "anexos",
    "arquivo", "arquivos", "documento", "documentos", "edital", "edital completo", "integra",
    "texto integral", "pdf", "doc", "docx", "xls", "xlsx", "zip", "planilha", "formulario", "resultado",
    "aqui", "link", "detalhes", "mais", "inscricao", "inscreva-se", "acesse o edital",
)
PRINCIPAL_LABELS = ("edital completo", "texto integral", "integra", "edital", "chamada", "baixar", "download", "documento", "pdf", "arquivo", "aviso")
SECONDARY_LABELS = (
    "anexo", "retificacao", "errata", "adendo", "aditamento", "resultado", "formulario", "cronograma",
    "planilha", "modelo", "manual", "tabela", "faq", "perguntas", "apresentacao", "slide", "relatorio", "termo",
)
NAVIGATION_LABELS = ("clique aqui", "saiba mais", "leia mais", "veja mais", "ver mais", "acesse", "acesso", "mais informacoes", "faq", "perguntas frequentes", "voltar", "inicio", "home", "contato", "fale conosco")
FILE_TYPES = {"pdf": "PDF", "doc": "DOC", "docx": "DOC", "xls": "XLS", "xlsx": "XLS", "zip": "ZIP", "rar": "ZIP", "odt": "DOC", "ods": "XLS", "ppt": "PPT", "pptx": "PPT"}
NEXT_LABELS = ("proxima", "proximo", "proximos", "next", "seguinte", "seguintes", "avancar", "mais resultados", "ver mais", "load more", "carregar mais", "show more")
NEXT_SYMBOLS = ("»", "›", ">>", ">", "→", "▶")
LISTING_HINTS = (
    ("chamadas publicas", 10), ("chamada publica", 10), ("editais", 10), ("edital", 7), ("chamadas", 8),
    ("chamada", 6), ("oportunidades", 7), ("opportunities", 7), ("calls for proposals", 10),
    ("call for proposals", 10), ("calls", 6), ("appels a candidatures", 10), ("appels", 6), ("bolsas", 6),
    ("scholarships", 7), ("becas", 6), ("convocatorias", 8), ("financiamentos", 5), ("fomento", 5),
    ("programas", 3), ("noticias", 2), ("news", 2),
)
LISTING_VETOES = (
    "licitac", "contratos", "compras", "pregao", "dispensa", "concurso publico",
    "processo seletivo simplificado", "servidores", "folha de pagamento", "privacidade", "cookies",
    "acessibilidade", "mapa do site", "ouvidoria", "webmail", "intranet", "login", "wp-admin", "wp-login", "feed",
)
LAST_LABELS = ("ultima", "ultimo", "last", "fim", "final", "end")
PAGER_CLASSES = (
    "pagination", "pager", "page-numbers", "paginacao", "paginator", "listingBar", "listing-bar",
    "nav-links", "wp-pagenavi", "pages", "paging", "page-nav",
)

# Fixed values.
TITLE_PREFIXES = (
    r"^em\s+(?:C[áa]tedra|Estudantes|Pesquisadores\s+e\s+Professores|Profissionais|Professores|Alunos|Institui[çc][õo]es|Universidades|Escolas)\s+",
    r"^(?:Categoria|Tipo|Se[çc][ãa]o|Programa)\s*:\s*",
    r"^\s*[-–—•]\s+",
)
# Fixed values.
BODY_CUES = (
    r"\s+A\s+Comiss[ãa]o\s+[\w,\s]{0,40}?(?:oferece|receber|com\s+apoio)",
    r"\s+S[ãa]o\s+oferecidas?\s+",
    r"\s+(?:Destinad[ao]s?|Voltad[ao]s?|Dirigid[ao]s?)\s+a\s+",
    r"\s+(?:Bolsas?|Aux[íi]lios?)\s+para\s+(?:desenvolver|realizar|atuar|estudar)",
    r"\s+Por\s+meio\s+d[aeo]\s+",
    r"\s+Para\s+(?:atuar|desenvolver|realizar)\s+n[ao]\s+",
    r"\s+A\s+C[áa]tedra\s+(?:destina|se\s+destina)",
    r"\s+O\s+\w+\s+oferece\s+",
    r"\s+Este\s+(?:edital|programa|chamada)\s+",
    r"\s+Com\s+o\s+objetivo\s+de\s+",
    r"\s+Inscri[çc][õo]es\s+(?:abertas|at[ée]|encerram)",
    r"\s+(?:Professores?|Pesquisadores?|Estudantes?|Candidatos?|Alunos?|Jovens)\s+[\w,\s]{0,40}?(?:podem|poder[ãa]o|dever[ãa]o)\s+",
    r"\s+Para\s+(?:professor|pesquisador|estudante|aluno|profissional)e?s?\s+",
    r"\s+(?:Bolsa|Programa|Chamada)\s+(?:para|de)\s+\w+\s+\w+\s+(?:em|na|no|nos|nas)\s+",
)
# Fixed values.
NAVIGATION = (
    r"^(?:apresenta[çc][ãa]o|hist[óo]rico|miss[ãa]o(?:\s+e\s+valores)?|quem\s+somos)$",
    r"^(?:in[íi]cio|home|p[áa]gina\s+inicial|portal)$",
    r"^(?:contato|fale\s+conosco|ouvidoria|imprensa|not[íi]cias)$",
    r"^(?:compartilh(?:e|ar|amento)|share)(?:\s+(?:no|na|on|via)\s+.*)?$",
    r"^(?:facebook|linkedin|twitter|instagram|whatsapp|youtube)$",
    r"^(?:transpar[êe]ncia|acesso\s+[àa]\s+informa[çc][ãa]o|carta\s+de\s+servi[çc]os)$",
    r"^(?:perguntas\s+frequentes|f\.?a\.?q\.?|d[úu]vidas)$",
    r"^(?:c[âa]mara|comiss[ãa]o|conselho|diretoria|pr[óo]-reitoria|secretaria)\b",
    r"^atas?\s+(?:da|do|de)\b",
    r"^(?:regimento|estatuto|portaria|resolu[çc][ãa]o|instru[çc][ãa]o\s+normativa)\b",
    r"^(?:organograma|equipe|servidores|administrador)$",
    r"^carreira\s+cient[íi]fica$",
    r"^difus[ãa]o\s+do\s+conhecimento$",
    r"^(?:conselho|c[âa]mara)\s+cient[íi]fico",
    r"^(?:in[íi]cio|sobre)\s+a\s+universidade",
    r"^(?:cursos?|unidades?|campi)$",
    r"^(?:bolsas?|aux[íi]lios?|modalidades?)(?:\s+(?:no\s+)?(?:pa[íi]s|exterior|nacionais?|internacionais?|vigentes?|dispon[íi]veis?))?$",
    r"^(?:outras?\s+)?(?:bolsas?|oportunidades?|op[çc][õo]es)(?:\s+(?:nacionais?|internacionais?|de\s+mobilidade))?$",
    r"^(?:programas?|a[çc][õo]es|editais?|chamadas?)(?:\s+(?:e\s+\w+|vigentes?|abertos?|anteriores?|encerrados?))?$",
    r"^(?:mobilidade|interc[âa]mbio|est[áa]gio)(?:\s+(?:virtual|para\s+o\s+exterior|out|in|internacional))?$",
    r"^(?:gradua[çc][ãa]o|p[óo]s-?gradua[çc][ãa]o|mestrado|doutorado|p[óo]s-?doutorado|extens[ãa]o|pesquisa|inova[çc][ãa]o)$",
    r"^(?:professor\s+visitante|t[ée]cnicos?-administrativos?|discentes?|docentes?)$",
    r"^registro\s+d[ao]\b",
    r"^como\s+funciona\b",
    r"^guide\s+for\b",
    r"^(?:manual|tutorial|formul[áa]rios?|modelos?|planilhas?|tabelas?)\b",
    r"^(?:taxa|taxas|tjlp|tr\b|quadro\s+de\s+tarifa)",
    r"^(?:cr[ée]dito|financiamento|subven[çc][ãa]o|conv[êe]nios?)\b",
    r"^termo\s+de\s+(?:fomento|colabora[çc][ãa]o|coopera[çc][ãa]o)",
    r"^(?:obras\s+do\s+estado|licita[çc][õo]es)",
    r"^orienta[çc][õo]es\b",
    r"^acesso\s+\w+\s+via\s+vpn",
    r"^e-?mail\s+do\s+pesquisador$",
    r"^cart[ãa]o\s+(?:bolsista|pesquisa)",
    r"^di[áa]rias\s+para",
    r"^indicadores\s+de\s+pesquisa$",
    r"^grupos\s+de\s+pesquisa\s*-\s*censos$",
    r"^missao\s+",
    r"^\s*(?:internacional|nacional)\s+\w+\s*$",
)
OPPORTUNITY_MARKS = r"\b(chamada|edital|programa\s+\w|bolsas?\s+(?:de|para)|call\s+for|convocat|appel|fellowship|grant|scholarship|pr[êe]mio|c[áa]tedra|auxílio\s+(?:a|para)|sandu[íi]che|mobility|exchange|interc[âa]mbio\s+\w)\b"

# Fixed values.
COUNTRIES = (
    "alemanha", "alemao", "alema", "germany", "german",
    "franca", "frances", "francesa", "france", "french",
    "portugal", "portugues", "portuguesa",
    "espanha", "espanhol", "espanhola", "spain", "spanish",
    "italia", "italiano", "italiana", "italy", "italian",
    "reino unido", "inglaterra", "united kingdom", "britanic", "british",
    "estados unidos", "united states", "americano",
    "canada", "canadense", "canadian",
    "japao", "japones", "japonesa", "japan", "japanese",
    "china", "chines", "chinesa", "chinese",
    "coreia", "korea", "korean",
    "argentina", "argentino", "chile", "chileno", "uruguai", "paraguai",
    "colombia", "peru", "mexico", "mexicano", "bolivia", "equador",
    "holanda", "paises baixos", "netherlands", "dutch",
    "belgica", "belgian", "suica", "switzerland", "swiss",
    "suecia", "sweden", "noruega", "norway", "dinamarca", "denmark",
    "finlandia", "finland", "austria", "irlanda", "ireland",
    "australia", "nova zelandia", "new zealand",
    "mocambique", "angola", "cabo verde", "africa do sul", "south africa",
    "india", "israel", "turquia", "polonia", "poland",
    "republica tcheca", "hungria", "romenia", "grecia", "greece",
    "uniao europeia", "european union", "mercosul", "brics",
    "ibero americ", "iberoameric", "latin america", "america latina",
    "europa", "europe", "europeu", "europeia",
)
FOREIGN_CALLS = ("call for", "applications are", "apply now", "appel a candidatures", "appel a projets", "convocatoria", "how to apply", "eligibility")
