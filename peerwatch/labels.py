"""Constants, texts and report headings that results must equal."""

from __future__ import annotations

from datetime import date

# Parameters of the analysis.
PERIOD_START = date(2016, 1, 1)
PERIOD_END = date(2025, 7, 1)
PEER_COUNT = 4
PEER_COUNTS_TRIED = (2, 3, 4, 5, 6)
KMEANS_RESTARTS = 10
SEED = 42
SCATTER_ROWS = 15000
Z_MODERATE = 2.0
Z_CRITICAL = 3.0
TREES = 200
CONTAMINATION = 0.01
CONTAMINATIONS = (0.01, 0.03, 0.05)
MIN_PEER_ROWS = 30
RATE_STD_FLOOR = 1e-9
TOTAL_STD_FLOOR = 1e-3
MAD_FLOOR = 1e-3
MAD_FACTOR = 0.6745
ROBUST_Z_LIMIT = 3.5
PERCENTILES = (0.95, 0.975, 0.99)
TOP_CASES = 20
TRIM_PERCENTILE = 0.99
CLIP_PERCENTILE = 0.995
HISTOGRAM_BINS = 50
SERIES_YEARS = (2016, 2025)
PROFILE_RATE = 0.30
PROFILE_TOTAL = 30000
PROFILE_MISSING = 0.90

# Status names, in order of severity.
STATUS_CRITICAL = "RISCO CRÍTICO"
STATUS_MODERATE = "ALERTA MODERADO"
STATUS_MULTIVARIATE = "ALERTA MULTIVARIADO"
STATUS_NORMAL = "NORMAL"
ALERT_STATUSES = (STATUS_CRITICAL, STATUS_MODERATE, STATUS_MULTIVARIATE)

# Reason texts.
REASON_CRITICAL = "Cancelamento muito acima do grupo"
REASON_MODERATE = "Cancelamento acima do grupo"
REASON_FOREST = "Anomalia multivariada"
REASON_NONE = "Sem motivo adicional"

# Explanation texts.
EXPLAIN_CRITICAL = "Taxa de cancelamento superior a três desvios-padrão em relação ao grupo de porte"
EXPLAIN_MODERATE = "Taxa de cancelamento superior a dois desvios-padrão em relação ao grupo de porte"
EXPLAIN_FOREST = "Combinação entre volume e cancelamento classificada como atípica pelo Isolation Forest"
EXPLAIN_NONE = "Sem motivo adicional identificado"

# Justification texts.
JUSTIFY_RATE = "taxa de cancelamento de %.4f%%"
JUSTIFY_MEAN = "média de %.4f%% no Cluster %d"
JUSTIFY_Z = "Z-Score de %.2f"
JUSTIFY_FOREST = "combinação entre volume operacional e cancelamento classificada como atípica pelo Isolation Forest"
JUSTIFY_NONE = "Registro sem evidência adicional de comportamento atípico."

# Removal reasons, in report order.
REMOVED_INVALID = "Datas inválidas"
REMOVED_BEFORE = "Antes de {year}"
REMOVED_BEFORE_MONTH = "Antes de {month} de {year}"
REMOVED_AFTER = "Após {month} de {year}"
MONTHS = (
    "janeiro", "fevereiro", "março", "abril", "maio", "junho",
    "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
)

# Peer-group names.
PEER_NAMES = {0: "Muito pequeno porte", 1: "Pequeno porte", 2: "Médio porte", 3: "Grande porte"}

# Operating profiles, first match wins.
PROFILE_HIGH_RATE = "Alta taxa de cancelamento"
PROFILE_HIGH_VOLUME = "Alto volume operacional"
PROFILE_HIGH_MISSING = "Alta incidência de selos sem guia"
PROFILE_LOW_MISSING = "Baixa incidência de selos sem guia"

# Direction of a deviation.
ABOVE = "Acima do grupo"
BELOW = "Abaixo do grupo"
AT_CENTRE = "Igual ao centro do grupo"

# Persistence bands with their lower limits, in report order.
BANDS = (
    ("Muito alta (≥ 99%)", 99.0),
    ("Alta (95% a 98,99%)", 95.0),
    ("Moderada (80% a 94,99%)", 80.0),
    ("Baixa (< 80%)", None),
)
TOTAL_ROW = "Total"

# Method names, limits and overlap classes.
METHOD_CLASSIC = "Z-Score tradicional"
METHOD_ROBUST = "Robust Z-Score"
LIMIT_CLASSIC = "|Z| > 2.0"
LIMIT_ROBUST = "|RZ| > 3.5"
OVERLAP_BOTH = "Alertas identificados pelos dois métodos"
OVERLAP_CLASSIC = "Somente Z-Score tradicional"
OVERLAP_ROBUST = "Somente Robust Z-Score"
OVERLAP_NONE = "Não identificados por nenhum método"
SPEARMAN_RHO = "Correlação de Spearman"
SPEARMAN_P = "P-valor"

# Rows of the general statistics report.
GENERAL_ROWS = ("Registros Originais", "Registros Após Limpeza", "Removidos", "% Removido")
PERIOD_ROWS = ("Data mínima", "Data máxima")
REMOVAL_ROWS = (
    "Serventias na base original",
    "Serventias na base analítica",
    "Serventias excluídas integralmente",
    "Média (%) de registros removidos",
    "Mediana (%)",
    "Desvio padrão (%)",
    "Mínimo (%)",
    "Máximo (%)",
)
PERSISTENCE_ROWS = (
    "Total de serventias",
    "Serventias com comparações consecutivas",
    "Serventias sem comparação consecutiva",
    "Serventias sem mudança",
    "Serventias com uma mudança",
    "Serventias com duas mudanças",
    "Serventias com três ou mais mudanças",
    "Serventias com alguma mudança",
    "Persistência temporal média (%)",
    "Persistência temporal mediana (%)",
    "Menor persistência temporal (%)",
    "Maior persistência temporal (%)",
    "Média de mudanças por serventia",
    "Mediana de mudanças por serventia",
    "Maior número de mudanças",
)

# Label of a single case, from the entity and MM/yyyy.
CASE_LABEL = "Serventia %s | %s"

# Headings of the published reports, keyed by engine column.
HEADINGS = {
    "before_after_by_year": {
        "year": "Ano", "before_n": "Antes", "after_n": "Depois", "removed_n": "Removidos", "removed_pct": "% Removido",
    },
    "before_after_by_entity": {
        "entity_id": "cartorio_id", "before_n": "Antes", "after_n": "Depois", "removed_n": "Removidos",
        "removed_pct": "% Removido",
    },
    "removal_reasons": {"reason": "Motivo", "rows_n": "Quantidade"},
    "general_stats": {"indicator": "Indicador", "value": "Valor"},
    "period_bounds": {"indicator": "Descrição", "value": "Valor"},
    "removal_stats": {"indicator": "Estatística", "value": "Valor"},
    "flag_diagnostics": {
        "year": "Ano", "total": "total_registros_transacionais", "cancelled_n": "total_cancelados",
        "not_cancelled_n": "total_nao_cancelados_explicitos", "null_flag_n": "total_inutilizado_nulo",
        "null_flag_pct": "percentual_inutilizado_nulo",
    },
    "excluded_entity_years": {"entity_id": "cartorio_id", "year": "ano", "rows_n": "Registros"},
    "k_sweep": {
        "k": "k", "inertia": "inercia", "silhouette": "silhouette", "davies_bouldin": "davies_bouldin",
        "calinski_harabasz": "calinski_harabasz", "smallest": "menor_cluster", "largest": "maior_cluster",
    },
    "cluster_profile": {
        "peer_group": "cluster_par", "rows_n": "registros", "entities_n": "serventias_distintas",
        "total_min": "minimo_total_selos", "total_mean": "media_total_selos", "total_median": "mediana_total_selos",
        "total_max": "maximo_total_selos", "rate_mean_pct": "media_taxa_cancelamento",
        "rate_median_pct": "mediana_taxa_cancelamento", "base_pct": "percentual_base",
    },
    "cluster_by_year": {"year": "Ano", "peer_group": "cluster_par", "rows_n": "Quantidade"},
    "cluster_rules": {
        "peer_group": "Cluster", "rows_n": "Registros", "base_pct": "% da Base", "entities_n": "Serventias",
        "total_mean": "Média de Selos", "rate_mean_pct": "Média Cancelamento (%)",
        "missing_mean_pct": "Média Selos sem Guia (%)", "profile": "Perfil Operacional",
    },
    "status_distribution": {
        "status": "Status", "alerts_n": "Quantidade", "alerts_pct": "Percentual_Alertas", "base_pct": "Percentual_Base",
    },
    "reason_distribution": {"reason": "Motivo do Alerta", "alerts_n": "Quantidade", "alerts_pct": "Percentual (%)"},
    "alerts_by_cluster": {
        "peer_group": "Cluster", "alerts_n": "Alertas", "rows_n": "Registros do Cluster",
        "alerts_pct": "% dos Alertas", "alert_rate_pct": "Taxa de Alertas no Cluster (%)",
    },
    "top_alerts": {
        "position": "Posição", "entity_id": "Serventia", "month_label": "Mês", "peer_group": "Cluster", "z": "Z-Score",
        "priority": "Score de Prioridade", "status": "Status", "reason": "Motivo", "justification": "Justificativa",
    },
    "top_alerts_full": {
        "position": "posicao_ranking", "entity_id": "cartorio_id", "month": "mes", "peer_group": "cluster_par",
        "total": "total_selos", "cancelled_n": "total_cancelados", "rate": "taxa_cancelamento",
        "rate_mean": "media_cancelamento_grupo", "z": "z_score_par", "if_label": "iforest_score",
        "if_intensity": "iforest_intensidade", "priority": "score_prioridade", "status": "status_metodologico",
        "reason": "categoria_motivo", "justification": "justificativa_alerta",
    },
    "peer_stats": {
        "peer_group": "cluster_par", "group_n": "quantidade_grupo", "rate_mean": "media_cancelamento_grupo",
        "rate_median": "mediana_cancelamento_grupo", "rate_std": "desvio_cancelamento_grupo",
        "rate_p90": "percentil90_cancelamento_grupo", "total_mean": "media_selos_grupo",
        "total_median": "mediana_selos_grupo", "rate_mean_pct": "media_cancelamento_pct",
        "rate_median_pct": "mediana_cancelamento_pct", "rate_std_pct": "desvio_cancelamento_pct",
        "rate_p90_pct": "percentil90_cancelamento_pct",
    },
    "mad_diagnostics": {
        "peer_group": "cluster_par", "rows_n": "observacoes", "value_median": "mediana_taxa", "mad": "mad",
        "value_min": "taxa_minima", "value_max": "taxa_maxima", "zero_pct": "percentual_zero",
    },
    "percentile_vs_z": {
        "peer_group": "cluster_par", "percentile": "percentil", "limit_value": "limite_taxa",
        "z_alerts": "alertas_z_maior_2", "percentile_alerts": "alertas_percentil", "shared": "alertas_em_comum",
        "z_kept_pct": "perc_alertas_z_mantidos",
    },
    "contamination_sweep": {
        "contamination_pct": "Contamination (%)", "forest_n": "Alertas Isolation Forest",
        "forest_pct": "Isolation Forest (% da Base)", "hybrid_n": "Alertas Híbridos",
        "hybrid_pct": "Modelo Híbrido (% da Base)", "critical_n": "Riscos Críticos",
        "critical_pct": "Riscos Críticos (% da Base)", "both_n": "Convergência Z-Score + IF",
        "only_forest_n": "Somente Isolation Forest", "only_z_n": "Somente Z-Score",
    },
    "contamination_overlap": {
        "contamination_pct": "Contamination comparada (%)", "forest_shared": "Alertas IF compartilhados com 1%",
        "forest_new": "Novos alertas IF", "hybrid_shared": "Alertas híbridos compartilhados com 1%",
        "hybrid_new": "Novos alertas híbridos",
    },
    "method_comparison": {
        "method": "Método", "limit_text": "Limiar", "alerts_n": "Alertas", "base_pct": "Percentual da Base (%)",
    },
    "method_overlap": {"situation": "Situação", "rows_n": "Quantidade", "base_pct": "Percentual da Base (%)"},
    "method_by_cluster": {
        "peer_group": "Cluster", "rows_n": "Registros", "classic_n": "Alertas_Z_Tradicional",
        "robust_n": "Alertas_Z_Robusto", "both_n": "Alertas_Ambos", "only_classic_n": "Somente_Tradicional",
        "only_robust_n": "Somente_Robusto", "classic_pct": "Taxa_Z_Tradicional (%)", "robust_pct": "Taxa_Z_Robusto (%)",
    },
    "spearman_report": {"metric": "Métrica", "value": "Valor"},
    "top_abs_z": {
        "position": "Posição", "entity_id": "Serventia", "month_label": "Mês", "peer_group": "Cluster",
        "total": "Total de Selos", "z": "Z-Score", "robust_z": "Robust Z-Score",
        "other_flag": "Também identificado pelo Robust Z-Score",
    },
    "top_abs_robust": {
        "position": "Posição", "entity_id": "Serventia", "month_label": "Mês", "peer_group": "Cluster",
        "total": "Total de Selos", "z": "Z-Score", "robust_z": "Robust Z-Score",
        "other_flag": "Também identificado pelo Z-Score",
    },
    "entity_stability": {
        "entity_id": "cartorio_id", "months_n": "Meses_Observados", "comparisons_n": "Comparacoes_Consecutivas",
        "changes_n": "Mudancas_de_Cluster", "stays_n": "Permanencias", "persistence": "Persistencia_Temporal",
        "main_group": "Cluster_Predominante", "groups_n": "Clusters_Visitados",
    },
    "persistence_bands": {
        "band": "Faixa de Persistência Temporal", "entities_n": "Serventias", "entities_pct": "Percentual (%)",
    },
    "persistence_summary": {"indicator": "Indicador", "value": "Valor"},
    "transition_matrix": {"origin": "Origem", "destination": "Destino", "rows_n": "Quantidade"},
}
