"""Numbers of the protocols' standards and the names they are shown by."""

from __future__ import annotations

TLS_CIPHERS = {
    0x1301: "TLS_AES_128_GCM_SHA256", 0x1302: "TLS_AES_256_GCM_SHA384", 0x1303: "TLS_CHACHA20_POLY1305_SHA256",
    0xC02B: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256", 0xC02C: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384",
    0xC02F: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", 0xC030: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384",
    0xCCA8: "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256", 0xCCA9: "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305_SHA256",
    0xC009: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA", 0xC00A: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA",
    0xC013: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA", 0xC014: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA",
    0xC023: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA256", 0xC024: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA384",
    0xC027: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256", 0xC028: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA384",
    0x009E: "TLS_DHE_RSA_WITH_AES_128_GCM_SHA256", 0x009F: "TLS_DHE_RSA_WITH_AES_256_GCM_SHA384",
    0x0033: "TLS_DHE_RSA_WITH_AES_128_CBC_SHA", 0x0039: "TLS_DHE_RSA_WITH_AES_256_CBC_SHA",
    0x0067: "TLS_DHE_RSA_WITH_AES_128_CBC_SHA256", 0x006B: "TLS_DHE_RSA_WITH_AES_256_CBC_SHA256",
    0x009C: "TLS_RSA_WITH_AES_128_GCM_SHA256", 0x009D: "TLS_RSA_WITH_AES_256_GCM_SHA384",
    0x002F: "TLS_RSA_WITH_AES_128_CBC_SHA", 0x0035: "TLS_RSA_WITH_AES_256_CBC_SHA",
    0x003C: "TLS_RSA_WITH_AES_128_CBC_SHA256", 0x003D: "TLS_RSA_WITH_AES_256_CBC_SHA256",
}
NAS_MM = {
    0x41: "Registration Request", 0x42: "Registration Accept", 0x43: "Registration Complete", 0x44: "Registration Reject",
    0x45: "Deregistration Request (UE orig)", 0x46: "Deregistration Accept (UE orig)",
    0x47: "Deregistration Request (UE term)", 0x48: "Deregistration Accept (UE term)",
    0x50: "Service Request", 0x51: "Service Reject", 0x52: "Service Accept",
    0x55: "Configuration Update Command", 0x56: "Configuration Update Complete",
    0x57: "Authentication Request", 0x58: "Authentication Response", 0x59: "Authentication Reject",
    0x5A: "Authentication Failure", 0x5B: "Authentication Result", 0x5C: "Identity Request", 0x5D: "Identity Response",
    0x5E: "Security Mode Command", 0x5F: "Security Mode Complete", 0x60: "Security Mode Reject", 0x64: "5GMM Status",
    0x65: "Notification", 0x66: "Notification Response", 0x67: "UL NAS Transport", 0x68: "DL NAS Transport",
}
NAS_SM = {
    0xC1: "PDU Session Establishment Request", 0xC2: "PDU Session Establishment Accept", 0xC3: "PDU Session Establishment Reject",
    0xC5: "PDU Session Auth Command", 0xC6: "PDU Session Auth Complete", 0xC7: "PDU Session Auth Result",
    0xC9: "PDU Session Modification Request", 0xCA: "PDU Session Modification Reject", 0xCB: "PDU Session Modification Command",
    0xCC: "PDU Session Modification Complete", 0xCD: "PDU Session Modification Command Reject",
    0xD1: "PDU Session Release Request", 0xD2: "PDU Session Release Reject", 0xD3: "PDU Session Release Command",
    0xD4: "PDU Session Release Complete", 0xD6: "5GSM Status",
}
SBI_SERVICES = {
    "nudm-sdm": "UDM", "nudm-uecm": "UDM", "nudm-ueau": "UDM", "nudm-pp": "UDM", "nsmf-pdusession": "SMF", "namf-comm": "AMF", "namf-evts": "AMF",
    "npcf-smpolicycontrol": "PCF", "npcf-ue-policy-control": "PCF", "nausf-auth": "AUSF", "nnrf-nfm": "NRF", "nnrf-disc": "NRF", "nudr-dr": "UDR",
    "nbsf-management": "BSF", "nchf-spendinglimitcontrol": "CHF", "nnssf-nsselection": "NSSF",
}
SNMP_PDUS = {0xA0: "GetRequest", 0xA1: "GetNextRequest", 0xA2: "GetResponse", 0xA3: "SetRequest", 0xA4: "Trap", 0xA5: "GetBulkRequest", 0xA6: "InformRequest", 0xA7: "TrapV2", 0xA8: "Report"}
AJP_METHODS = {1: "OPTIONS", 2: "GET", 3: "HEAD", 4: "POST", 5: "PUT", 6: "DELETE", 7: "TRACE", 8: "PROPFIND"}
APPLY_ACTIONS = ("DROP", "FORW", "BUFF", "NOCP", "DUPL")
UP_FEATURES = ("BUCP", "DDND", "DLBD", "TRST", "FTUP", "PFDM", "HEEU", "TREU", "EMPU", "PDIU", "UDBC", "QUOAC", "TRACE", "FRRT", "PFDE")
DIAMETER_APPLICATIONS = {0: "Base", 1: "NASREQ", 3: "Accounting", 4: "Credit-Control", 16777216: "Cx", 16777217: "Sh", 16777236: "Rx", 16777238: "Gx", 16777251: "S6a", 16777265: "SWx"}
RAT_TYPES = {1: "UTRAN", 2: "GERAN", 3: "WLAN", 4: "GAN", 5: "HSPA", 6: "E-UTRAN", 7: "Virtual", 8: "NB-IoT", 9: "LTE-M", 10: "NR"}
PDN_TYPES = {1: "IPv4", 2: "IPv6", 3: "IPv4v6"}
#: Sizes of version 1 elements with a type below 128, type byte included.
GTP1_SIZES = {1: 2, 2: 9, 3: 7, 4: 5, 5: 5, 8: 2, 9: 29, 11: 2, 12: 4, 13: 2, 14: 2, 15: 2, 16: 3, 17: 3, 18: 5, 19: 2, 20: 5}
