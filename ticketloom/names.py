"""Column labels and constants of the ticket data model.

The labels and numbers below are fixed values: they are part of the data
contract (input headers, output headers, thresholds) and have to be equal to it.
"""

# Ticket table headers.
ID = "Id"
TITLE = "Título"
DESCRIPTION = "Descrição do chamado"
SOLUTION = "Última ação de acompanhamento"
TEAM = "Time"
CATEGORY = "Categoria"
STATUS = "Status"
PRIORITY = "Prioridade"
OPENED = "Data de abertura"
SOLVED = "Data de Solução"
UNIT = "Unidade"
STATE = "Estado"
HOURS = "Tempo em horas do atendimento"
HOURS_RECOMMENDER = "Tempo_Total_Atendimento_H"
HOURS_RECOMMENDER_ALT = "Tempo_Total_Atendimento"

# Text columns cleaned by the preparation job, accent-free and lower case.
CLEANED_LABELS = (
    "titulo",
    "descricao do chamado",
    "ultima acao de acompanhamento",
    "titulo da ultima acao padrao",
    "chamados relacionados",
)

# Where the description may be found, in order, and the words that give it away.
DESCRIPTION_CANDIDATES = (
    "Descrição do chamado",
    "Descrição do chamado_y",
    "Descrição do chamado_x",
)
DESCRIPTION_HINTS = ("descri", "chamado")

# Columns the metrics job drops.
DROPPED_COLUMNS = (
    "Total_Horas",
    "Tempo de atendimento",
    "Tempo total",
    "Tempo de Interação",
    "Tempo de interação dentro do SLA",
    "Tempo de Início do Atendimento",
    "Contém Anexo",
    "Origem da requisição",
    "Prioridade",
    "Total em Minutos",
)

# Fill values of the metrics job.
NULL_FILLS = {
    "Unidade": "Não Informado",
    "Estado": "Não Informado",
    "Time": "Não Atribuído",
}
UNCLASSIFIED = "NAO_CLASSIFICADO"

ALL_SYSTEMS = "TOTAIS"
GENERIC_SYSTEM = "Geral"

# Column order of the recommender's ticket base; extra columns follow.
RECOMMENDER_TICKET_ORDER = (
    "Id",
    "sistema_origem",
    "topico_id_unico",
    "Título",
    "Descrição do chamado",
    "Última ação de acompanhamento",
    "Time",
    "Categoria",
    "Status",
    "Prioridade",
    "Data de abertura",
    "Data de Solução",
    "Tempo_Total_Atendimento_H",
    "texto_completo",
    "link_solucao",
)
RECOMMENDER_TOPIC_ORDER = (
    "topico_id_unico",
    "sistema_origem",
    "topico_id_original",
    "label_curto",
    "resumo_sumarizado",
    "n_documentos",
    "keywords",
    "padrao_dominante",
    "impacto_operacional",
    "texto_para_embedding",
)

# Labels and headings inside summaries and prompts.
PATTERN_LABEL = "**Padrão Dominante**"
IMPACT_LABEL = "**Impacto Operacional**"
CORE_HEADING = "=== NÚCLEO (mais representativos do tópico) ==="
PERIPHERY_HEADING = "=== PERIFERIA (variações do mesmo tópico) ==="
NO_KEYWORDS = "(não disponível)"
USED_TITLES_HEADING = "[ALREADY USED TITLES — DO NOT REPEAT OR PARAPHRASE]"
SUMMARY_HEADING = "[TOPIC SUMMARY]"
NO_ACTION = "Sem última ação de acompanhamento documentada."

# Selection sizes, seeds and thresholds.
CORE_SIZE = 30
PERIPHERY_SIZE = 15
SEED = 42
TABLE_KEYWORDS = 8
MIN_DOCUMENTS = 100
TOP_TERMS = 10
HIGH_SCORE = 0.70
MEDIUM_SCORE = 0.50
TOPIC_FLOOR = 0.30
SUPPORT_FLOOR = 0.20
GENERIC_MARGIN = 0.10
WIDENING = 30
OVERFETCH = 3
CONCENTRATION = 0.6
