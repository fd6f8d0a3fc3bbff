"""Declared schemas (DDL) of the engine's tables; nothing is inferred."""

IMAGE = "struct<role:string,image_path:string,frame_id:string>"
INSTRUCTION = "struct<step:int,text:string,dominant_action:string,action_family:string,atomic_subtype:string>"
PROTOCOL = "struct<call_mode:string,num_model_calls:int,use_teacher_forcing:boolean,current_view_update_rule:string>"
MANIFEST = (
    "sample_id string, root_sample_id string, dataset string, scene_id string, context_type string, num_context_images int, instruction_type string, subtype string, "
    f"input_images array<{IMAGE}>, target_images array<{IMAGE}>, instructions array<{INSTRUCTION}>, evaluation_protocol {PROTOCOL}, pose_metadata string"
)
PREDICTION = (
    "benchmark_version string, manifest_sha256 string, model_id string, model_type string, case_id string, step_id int, "
    "output_path string, output_sha256 string, interface_type string, input_ids array<string>, prompt_sha256 string, generation string"
)
LABELS = "sample_id string, target_labels array<struct<detector_prompt_labels:array<string>,object_labels:array<string>>>"
POSE_RECORD = "id string, action_component string, action_expected double, action_pred double, action_abs_err double, action_sign_correct double, action_unit string"
FRAME = (
    "asset_id string, dataset string, scene_id string, image_ref string, loader_frame_idx int, image_path string, depth_path string, rgb_sha256 string, depth_sha256 string, "
    "image_height int, image_width int, depth_height int, depth_width int, extrinsics_c2w array<array<double>>, intrinsics array<array<double>>, "
    "asset_format_version string, asset_revision string, preprocessing string, resize_stages array<double>, calibration_source string"
)
ALL = {"manifest": MANIFEST, "prediction": PREDICTION, "labels": LABELS, "pose_record": POSE_RECORD, "frame": FRAME}
