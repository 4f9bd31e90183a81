"""Schemas of the tables the operators read and write."""

from __future__ import annotations

# Headings of the raw transaction extract and the names they are loaded under.
TRANSACTION_HEADINGS = {
    "Id Tlf": "id_tlf",
    "Fecha Transacción": "fecha_transaccion",
    "Cod Terminal": "cod_terminal",
    "Autorizador": "autorizador",
    "Tipo Operación": "tipo_operacion",
    "Cod Estado Transacción": "cod_estado_transaccion",
    "Cod Tipo Operación": "cod_tipo_operacion",
    "Operación": "operacion",
    "Canal": "canal",
    "Tipo Convenio": "tipo_convenio",
    "Adquiriente": "adquiriente",
    "Valor Transacción": "valor_transaccion",
    "Valor Transacción Original": "valor_transaccion_original",
    "Cantidad Tx": "cantidad_tx",
    "Duplicado": "duplicado",
    "Fecha Negocio": "fecha_negocio",
}

LINEAGE = ["archivo_origen", "mes_origen", "fecha_procesamiento"]

# Column kinds of the raw extract.
INT_HEADINGS = ["Cod Terminal", "Cod Estado Transacción", "Cod Tipo Operación", "Cantidad Tx", "Duplicado"]
FLOAT_HEADINGS = ["Valor Transacción", "Valor Transacción Original"]
TIME_HEADING = "Fecha Transacción"
DATE_HEADING = "Fecha Negocio"
TIME_FORMAT = "yyyy/MM/dd HH:mm:ss"

# Headings of the machine master and the names they are loaded under.
MACHINE_HEADINGS = {
    "Código (*)": "codigo",
    "Longitud (X)": "longitud",
    "Latitud (Y)": "latitud",
    "Municipio": "municipio",
    "Departamento": "departamento",
    "Tipo De Función": "tipo_funcion",
    "Horario De Atención Oficina": "horario_atencion_oficina",
    "Hora Apertura ATM": "hora_apertura_atm",
    "Hora Cierre ATM": "hora_cierre_atm",
    "Cajero Adyacente A Oficina": "cajero_adyacente_oficina",
    "Estado De Cajero": "estado_cajero",
    "Fecha De Instalación": "fecha_instalacion",
    "Centro Comercial": "centro_comercial",
    "Grandes Superficies": "grandes_superficies",
    "Regional Ath/Banco": "regional",
    "Nivel De Polución": "nivel_polucion",
    "Temperatura": "temperatura_promedio",
    "Tipo Site": "tipo_site",
    "VIP": "vip",
    "Uniplaza": "uniplaza",
    "Cierre Nocturno": "cierre_nocturno",
    "Capacidad Máx. De Aprovisionamiento": "capacidad_max_aprovisionamiento",
    "Marca": "marca",
    "Modelo": "modelo",
    "Técnico De Servicio": "tecnico_servicio",
    "Más Cajeros En El Mismo Site": "mas_cajeros_mismo_site",
}
MACHINE_FLAGS = [
    "cajero_adyacente_oficina",
    "centro_comercial",
    "grandes_superficies",
    "vip",
    "uniplaza",
    "cierre_nocturno",
    "mas_cajeros_mismo_site",
]

# Cash administration codes of the 15-minute file; only dispensing codes are analysed.
ADMIN_CODES = {
    1: "Provision",
    2: "Dispensacion acumulada",
    3: "Dispensacion antes de provision",
    4: "Dispensacion despues de provision",
    5: "Saldo actual",
    6: "Arqueo de la maquina",
    8: "Efectivo reciclado",
    9: "Efectivo reciclado antes de provision",
    10: "Efectivo reciclado despues de provision",
}
DISPENSING_CODES = [2, 3, 4]

# Note denominations, in thousands.
DENOMINATIONS = [20, 50, 100, 10, 5, 2, 1]
NOTE_COLUMNS = [f"billetes_{d}k" for d in DENOMINATIONS]

DISPENSING_TYPES = ["Retiro", "Avance"]
STATE_OK = 1
STATE_REJECTED = 2
PIN_CHANGE = "Cambio De Pin"

# Codes of the operation types.
OPERATION_CODES = {"Cambio De Pin": 1, "Avance": 2, "Retiro": 3, "Depositos": 4, "Transferencias": 5}

ALERT_COLUMNS = [
    "cod_cajero",
    "fecha_hora",
    "tipo_anomalia",
    "severidad",
    "score_anomalia",
    "monto_dispensado",
    "monto_esperado",
    "desviacion_std",
    "descripcion",
    "razones",
    "modelo_usado",
    "fecha_deteccion",
]
ALERT_KEY = ["cod_cajero", "fecha_hora"]

# The columns of the per-transaction feature table, by stored type.
TRANSACTION_FEATURES = {
    "id_transaccion": "bigint",
    "hora": "int",
    "dia_semana": "int",
    "es_fin_de_semana": "boolean",
    "es_horario_nocturno": "boolean",
    "es_madrugada": "boolean",
    "diferencia_valor": "double",
    "es_retiro_maximo": "boolean",
    "tiempo_desde_anterior_seg": "double",
    "es_transaccion_rapida": "boolean",
    "es_cambio_pin": "boolean",
    "tipo_operacion_encoded": "int",
    "transaccion_exitosa": "boolean",
    "transaccion_rechazada": "boolean",
    "tx_por_hora_cajero": "double",
    "monto_promedio_cajero": "double",
    "tasa_rechazo_cajero": "double",
    "desviacion_monto_cajero": "double",
    "velocidad_promedio_cajero": "double",
    "cajero_adyacente_encoded": "int",
    "cierre_nocturno_encoded": "int",
}
#: What the model of transactions is fitted on: all but the key.
TRANSACTION_MODEL_FEATURES = [c for c in TRANSACTION_FEATURES if c != "id_transaccion"]

# Model inputs, per 15-minute bucket and per machine.
BUCKET_MODEL_FEATURES = [
    "monto_total_dispensado",
    "num_transacciones",
    "hora_del_dia",
    "dia_semana",
    "mes",
    "es_fin_de_semana",
    "es_fin_de_mes",
    "es_quincena",
    "z_score_vs_cajero",
    "z_score_vs_hora",
    "z_score_vs_dia_semana",
    "percentil_vs_mes",
    "cambio_vs_anterior",
    "cambio_vs_ayer",
    "tendencia_24h",
    "volatilidad_reciente",
]
MACHINE_MODEL_FEATURES = [
    "dispensacion_promedio",
    "dispensacion_std",
    "coef_variacion",
    "transacciones_promedio_15min",
    "iqr",
    "disp_madrugada",
    "disp_manana",
    "disp_tarde",
    "disp_noche",
    "hora_pico",
    "ratio_fds_laboral",
    "std_por_hora",
    "tendencia_slope",
    "tendencia_r2",
    "volatilidad_reciente",
    "volatilidad_promedio",
    "cambio_reciente_pct",
    "pct_anomalias_2std",
    "pct_anomalias_3std",
    "max_z_score_historico",
    "cajeros_cercanos_1km",
    "ratio_vs_zona",
]
