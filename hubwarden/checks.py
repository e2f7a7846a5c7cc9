"""The check catalogue: severity, category, scan type and advice per check name."""

from __future__ import annotations

from typing import NamedTuple


class Check(NamedTuple):
    severity: str
    category: str
    advice: str


# Advice shown when a check has none of its own.
CATEGORY_ADVICE = {
    "dataset_poisoning": "Look through the flagged training entries for hostile content",
    "provenance_failure": "Confirm where the dataset came from and who handled it",
    "lora_backdoor": "Compare the adapter with a copy from a trusted publisher",
    "weight_tampering": "Compare the weights with a manifest from a trusted publisher",
    "pipeline_vulnerability": "Go over the training project's configuration",
    "supply_chain": "Trace the model from its base to where it is served",
    "configuration_risk": "",
}

SCAN_TYPE_OF_CATEGORY = {
    "dataset_poisoning": "dataset",
    "provenance_failure": "dataset",
    "lora_backdoor": "lora",
    "weight_tampering": "weights",
    "pipeline_vulnerability": "pipeline",
    "supply_chain": "pipeline",
    "configuration_risk": "full",
}


def _group(category: str, rows: dict[str, tuple[str, str | None]]) -> dict[str, Check]:
    fallback = CATEGORY_ADVICE[category]
    return {
        name: Check(severity, category, fallback if advice is None else advice)
        for name, (severity, advice) in rows.items()
    }


CHECKS: dict[str, Check] = {
    **_group(
        "dataset_poisoning",
        {
            "poisoning_trigger_pattern": ("critical", "Drop entries holding the trigger and re-check their origin"),
            "suspicious_instruction": ("high", "Drop entries that try to override instructions"),
            "label_flipping": ("high", "Check answers against the intended safety behaviour"),
            "file_too_large": ("info", "Raise the size limit or scan this file on its own"),
            "invalid_utf8": ("info", "Repair the file's encoding; its readable text was still scanned"),
            "duplicate_entries": ("medium", "Check whether repeated entries were replayed on purpose"),
            "role_imbalance": ("medium", "Check that conversations have balanced turns"),
            "length_anomaly": ("medium", "Check the entries of unusual length for injected data"),
            "short_entries": ("low", "Check the very short entries for trigger tokens"),
            "high_entropy_content": ("medium", "Check the high-entropy entries for encoded payloads"),
        },
    ),
    **_group(
        "provenance_failure",
        {
            "missing_provenance": ("medium", "Add provenance.json with source, creation date and checksum"),
            "incomplete_provenance": ("high", "Fill in source, creation date and checksum"),
            "corrupt_provenance": ("high", None),
            "missing_dataset_card": ("low", "Add a card that states sources, processing and known limits"),
            "missing_checksum_manifest": ("medium", "Add checksums.sha256 covering all data files"),
            "invalid_source_url": ("low", None),
        },
    ),
    **_group(
        "lora_backdoor",
        {
            "corrupt_adapter_config": ("high", None),
            "suspicious_target_modules": ("high", "Adapters on embedding or head layers can carry backdoors"),
            "uncommon_target_modules": ("low", "Confirm that these modules are meant to be adapted"),
            "missing_base_model": ("medium", "Name the base model in base_model_name_or_path"),
            "oversized_adapter": ("high", "The file may hold full weights instead of adapter deltas"),
            "undersized_adapter": ("medium", "The file may be damaged or replaced"),
            "high_lora_rank": ("medium", "A rank this high can rewrite the model's behaviour"),
            "high_lora_scale": ("low", None),
            "unreadable_adapter": ("medium", "Repair the file or leave the adapter out; its values were not judged"),
            "extreme_lora_weights": ("high", "Extreme values can be an injected backdoor"),
            "lora_embed_modification": ("high", "Changed embeddings are a known backdoor route"),
            "lora_lm_head_modification": ("high", "A changed head can redirect the model's output"),
            "trigger_keywords_in_config": ("medium", "Check the configuration for trigger definitions"),
        },
    ),
    **_group(
        "weight_tampering",
        {
            "symlinks_found": ("medium", "Check where the links lead; a link can be swapped after the audit"),
            "missing_weight_manifest": ("medium", "Write a weight manifest before deployment"),
            "corrupt_manifest": ("high", None),
            "weight_integrity_failed": ("critical", "Do not load these weights until their origin is confirmed"),
            "no_weight_files": ("high", "Check that the directory really holds a model"),
            "unsafe_weight_format": ("medium", "Convert the weights to .safetensors"),
            "suspicious_weight_filename": ("critical", "Confirm who published this weight file"),
            "small_model_size": ("medium", "Compare with the size this architecture should have"),
            "large_weight_file": ("info", None),
            "model_fingerprint": ("info", ""),
            "corrupt_fingerprint": ("high", ""),
            "fingerprint_mismatch": ("critical", "The weights changed after the fingerprint was recorded"),
        },
    ),
    **_group(
        "pipeline_vulnerability",
        {
            "unsafe_model_load": ("high", "Load .safetensors instead of pickled weights"),
            "suspicious_import": ("medium", "Check why the training script needs this call"),
            "hardcoded_credential": ("critical", "Move the credential to a secret store"),
            "credential_in_config": ("critical", "Move the credential to the environment"),
            "exposed_secret": ("critical", "Move the secret to a secret store"),
            "unpinned_dependencies": ("low", "Pin dependency versions"),
        },
    ),
    **_group(
        "supply_chain",
        {
            "unknown_base_model": ("high", "State the base model in the configuration or card"),
            "missing_training_record": ("medium", "Keep the training arguments with the model"),
            "root_deployment": ("medium", "Serve the model as an ordinary user"),
            "exposed_port": ("low", "Bind to 127.0.0.1 or put a proxy in front"),
            "missing_model_card": ("low", "Add a card on training data, evaluation, limits and use"),
            "incomplete_model_card": ("low", "Add the missing sections to the card"),
        },
    ),
    **_group(
        "configuration_risk",
        {
            "path_not_found": ("high", None),
            "unreadable_file": ("medium", "Check the file's access rights and size; it was not scanned"),
            "unreadable_directory": ("medium", "Check the directory's access rights; what it holds was not listed"),
            "oversized_document": ("medium", "Store the document as JSONL; its entries were not counted"),
        },
    ),
}
