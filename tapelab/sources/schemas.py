"""Fixed input schemas. Field names are those of the recorded files."""

from __future__ import annotations

LEVELS = "array<struct<precio:double,cantidad:double>>"
TAPE = (
    "schemaVersion int, exchangeTimestamp timestamp, localTimestamp timestamp, exchange string, pair string, "
    "source struct<type:string,url:string>, kind string, sequenceId bigint, previousSequence bigint, "
    f"bids {LEVELS}, asks {LEVELS}, "
    "integrity struct<status:string,gap:boolean,resync:boolean,connectionEpoch:bigint,reconnected:boolean>, "
    "observedLatencyMs bigint"
)
QUOTE_FIELDS = (
    "exchange:string,par:string,bid:double,bidCantidad:double,ask:double,askCantidad:double,"
    f"bids:{LEVELS},asks:{LEVELS},eventoUnixMs:bigint,recibidaEn:timestamp,latenciaMs:bigint,secuencia:bigint,"
    "exchangeSequence:bigint,integrityStatus:string,resyncs:bigint,sequenceGaps:bigint,checksumFailures:bigint,"
    "invalidatedMs:bigint,timestampConfiable:boolean,conectado:boolean,ultimoMensaje:string"
)
QUOTE = ", ".join(f.replace(":", " ", 1) for f in QUOTE_FIELDS.replace("precio:double,cantidad", "precio:double;cantidad").split(",")).replace(";", ",")
QUOTE_DOC = f"{QUOTE}, cotizaciones array<struct<{QUOTE_FIELDS}>>, eventos array<struct<{QUOTE_FIELDS}>>"
MANIFEST = (
    "schemaVersion int, datasetId string, sourceClassification string, startedAt timestamp, endedAt timestamp, "
    "exchanges array<string>, pairs array<string>, events bigint, snapshots bigint, sequenceGaps bigint, "
    "restFallbackEvents bigint, reconnectEvents bigint, deliveryPolicy string, eventsByExchange map<string,bigint>, "
    "uncompressedBytes bigint, durationMs bigint, sha256 string, gitCommit string, gitDirty boolean, configSha256 string"
)
CAPTURE = "schemaVersion int, pair string, exchanges array<string>, depth int"
# What a manifest of an older recorder means.
MANIFEST_DEFAULTS = {
    "datasetId": "", "sourceClassification": "public_market_capture", "deliveryPolicy": "bounded_channel_await_no_application_drop",
    "reconnectEvents": 0, "restFallbackEvents": 0, "uncompressedBytes": 0, "gitDirty": True, "gitCommit": "",
}
_BAL = "map<string,struct<btc:decimal(38,18),usd:decimal(38,18)>>"
_AMT = ("quantity_btc", "execution_price_usd", "reference_price_usd", "fee_usd", "btc", "usd", "cost_usd")
LEDGER = (
    f"version string, runId string, initialBalances {_BAL}, finalBalances {_BAL}, "
    "events array<struct<id:string,sequence:bigint,previousHash:string,hash:string,type:string,fill_id:string,exchange:string,"
    "side:string,from_exchange:string,to_exchange:string," + ",".join(f"{a}:decimal(38,18)" for a in _AMT) + ">>, "
    "markPriceUsd decimal(38,18), reportedNetPnlUsd decimal(38,18), eventCount bigint, headHash string"
)
# the same documents with the amounts of events as the text they have in the file
LEDGER_TEXT = LEDGER
for _a in _AMT:
    LEDGER_TEXT = LEDGER_TEXT.replace(f",{_a}:decimal(38,18)", f",{_a}:string")
# The fields that the hash of a document's event covers, in their order.
EVENT_FIELDS = {
    "fill": ("fill_id", "exchange", "side", "quantity_btc", "execution_price_usd", "reference_price_usd", "fee_usd"),
    "rebalance": ("from_exchange", "to_exchange", "btc", "usd", "cost_usd"),
    "withdrawal_amortization": ("exchange", "cost_usd"),
}
