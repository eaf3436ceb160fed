"""The canonical conversation: one nested row per conversation, and its dimension tables."""

from __future__ import annotations

VERSION = "1.0.0"
LABELS = "struct<is_scam:int,scam_type:string,tactics:map<string,int>,stage:string,provenance:string>"
TURN = f"struct<turn_id:int,speaker_role:string,raw_text:string,normalized_text:string,language:string,labels:{LABELS}>"
SOURCE = "struct<dataset_id:string,repository:string,revision:string,license:string,record_id:string,original_split:string,source_type:string>"
CONVERSATION = (
    f"schema_version string, conversation_id string, source {SOURCE}, language_profile array<string>, "
    "conversation_label struct<is_scam:int,scam_type:string,provenance:string>, "
    f"turns array<{TURN}>, metadata map<string,string>, "
    "fingerprints struct<exact_sha256:string,template_sha256:string,simhash64:string>, "
    "quality struct<training_eligible:boolean,exclusion_reasons:array<string>,label_quality:string>, duplicate_of string"
)
SPLITS = ("train", "validation", "test")

# fixed values: the closed vocabularies of the data model
TACTICS = [
    "authority_impersonation", "accusation", "fear_threat", "urgency", "secrecy", "isolation",
    "surveillance_control", "financial_demand", "credential_otp_request",
]
SCAM_TYPES = [
    "non_scam", "digital_arrest", "fake_kyc_bank", "courier_customs", "otp_account_takeover", "investment",
    "loan_job", "tech_support", "impersonation_other", "other_scam",
]
STAGES = [
    "contact", "authority_claim", "accusation", "threat", "isolation_control", "payment_extraction",
    "post_payment", "none_unknown",
]
