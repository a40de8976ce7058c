"""The data model: tables, product types, and a registry that takes new ones without a change here."""

from __future__ import annotations

from dataclasses import dataclass

#: Logical tables as DDL.
TABLES = {
    "products": "product_id string, product string, name string, description string, domain string, ts_raw string, ts timestamp, tz_offset string, schema_version int, id_inputs string, content_hash string, default_path string, schema_json string",
    "nodes": "product_id string, path string, parent string, name string, depth int, kind string",
    "attrs": "product_id string, path string, key string, value string, value_type string",
    "datasets": "product_id string, path string, dtype string, shape array<bigint>, chunk_shape array<bigint>, units string, unit_si double",
    "chunks": "product_id string, path string, chunk_idx bigint, origin array<bigint>, extent array<bigint>, data binary, chunk_hash string",
    "sources": "product_id string, role string, name string, source_id string, source_product string, file string, content_hash string",
    "original_files": "product_id string, path string, sha256 string, size_bytes bigint",
    "frames": "product_id string, frame int, frame_start double, frame_duration double, frame_label string",
    "channel_samples": "product_id string, channel string, i bigint, t double, signal double",
    "bins": "product_id string, ax0 int, ax1 int, n double, err double",
    "axes": "product_id string, dim int, label string, units string, unit_si double, edges array<double>",
    "regions": "product_id string, label int, name string, anatomy string, vocabulary string, code string",
    "calibrations": "product_id string, calibration_type string, scanner_model string, scanner_serial string, valid_from string, valid_until string",
}

#: Attributes of every root; then the one that measured data need, and the optional ones.
REQUIRED = ("_schema_version", "product", "id", "id_inputs", "name", "description", "content_hash")
CONDITIONAL = ("timestamp",)
OPTIONAL = ("domain", "default")

#: Names that a schema may not use for anything else.
RESERVED = ("_type", "_version", "_schema", "_schema_version", "_errors", "_vocabulary", "_code", "description", "default", "id", "id_inputs", "content_hash")

#: Subtypes by the group that carries them.
CALIBRATION_TYPES = {
    "energy_calibration": ("channel_to_energy", "reference_spectrum"),
    "gain_map": ("gain_map",),
    "normalization": ("norm_factors", "efficiency_map"),
    "dead_time": ("dead_time_curve",),
    "timing_calibration": ("timing_offsets", "resolution_curve"),
    "crystal_map": ("crystal_positions", "crystal_ids"),
    "sensitivity": ("sensitivity_profile",),
    "cross_calibration": (),
}
SPECTRUM_METHODS = ("energy", "lifetime", "doppler", "angular", "timing", "coincidence_matrix")
REGION_METHODS = {
    "manual": ("tool", "operator"),
    "threshold": ("threshold_value", "threshold_type", "seed_region"),
    "ai_segmentation": ("model", "model_version", "weights_hash", "task"),
    "atlas": ("atlas_name", "registration_method", "template_space"),
    "geometric": ("coordinate_system",),
}
DEVICE_TYPES = ("blood_sampler", "motion_tracker", "infusion_pump", "physiological_monitor", "environmental_sensor")


@dataclass(frozen=True)
class ProductType:
    """What identifies a product of a type (besides the type itself) and what it must contain, as paths."""

    identity: tuple[str, ...]
    members: tuple[str, ...] = ()
    one_of: tuple[str, ...] = ()
    measured: bool = True
    schema: str = "{}"


_acquired = ("timestamp", "scanner_uuid", "vendor_series_id")

#: The product types of the medical domain. Identity of sinograms and device data is our choice.
_types = {
    "recon": ProductType(_acquired, ("volume", "metadata", "provenance")),
    "listmode": ProductType(_acquired, ("metadata", "provenance"), ("raw_data", "proc_data")),
    "sinogram": ProductType(_acquired, ("sinogram", "metadata", "provenance")),
    "sim": ProductType(("simulation_config_hash", "random_seed"), ("metadata/simulation", "provenance"), measured=False),
    "transform": ProductType(("source_id", "target_id", "method_type", "creation_timestamp"), ("metadata/method", "sources"), ("matrix", "displacement_field")),
    "calibration": ProductType(("scanner_uuid", "calibration_type", "valid_from"), ("metadata/calibration", "data", "provenance")),
    "spectrum": ProductType(("source_id", "method_type", "creation_timestamp"), ("counts", "axes", "metadata/method")),
    "roi": ProductType(("reference_image_id", "method_type", "creation_timestamp"), ("regions", "metadata/method"), ("mask", "geometry", "contours")),
    "device_data": ProductType(("device_model", "recording_start"), ("channels", "metadata/device", "provenance")),
}


def register(name: str, kind: ProductType) -> None:
    """Add a product type of another domain; a type cannot be replaced by a different one."""
    if _types.setdefault(name, kind) != kind:
        raise ValueError(f"{name} is registered already")


def product_types() -> dict[str, ProductType]:
    return dict(_types)
