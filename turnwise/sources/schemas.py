"""The canonical tables. ``pos`` is a row's place in its source list; several rules depend on it."""

from __future__ import annotations

QUERIES = (
    "dataset string, pos long, query_id string, reference_image_id string, target_image_id string, relative_caption string, "
    "ground_truth_ids array<string>, caption_index int, original_captions array<string>, valid_captions array<string>, "
    "shared_concept string, original_reference_id string, original_target_id string, original_gt_ids array<string>"
)
IMAGES = "dataset string, split string, category string, pos long, image_id string, image_path string, img_hash string, duplicate_paths array<string>"
FEATURES = "dataset string, model string, img_hash string, image_id string, corpus_idx long, vec array<float>"
CAPTIONS = "dataset string, image_key string, caption string"
CAPTION_FEATURES = "dataset string, image_key string, feature_type string, vec array<float>"
TURN = (
    "turn:int,query_text:string,search_results:array<struct<id:string,score:double>>,selected_image:string,"
    "selected_image_caption:string,relative_caption:string,gt_rankings:map<string,int>,best_gt_rank:int"
)
SESSIONS = (
    "dataset string, pos long, query_id string, reference_image_id string, target_image_id string, ground_truth_ids array<string>, "
    f"original_query string, success boolean, success_turn int, turns array<struct<{TURN}>>"
)
# Result files write a hit as a pair [id, score].
_FILE_TURN = TURN.replace("array<struct<id:string,score:double>>", "array<array<string>>")
SESSION_FILE = (
    "dataset_name string, results array<struct<query_id:string,reference_image_id:string,target_image_id:string,ground_truth_ids:array<string>,"
    f"original_query:string,success:boolean,success_turn:int,turns:array<struct<{_FILE_TURN}>>>>"
)
# A session a line, as result folders have them.
SESSION_LINE = (
    "pos long, query_id string, reference_image_id string, target_image_id string, ground_truth_ids array<string>, "
    f"original_query string, success boolean, success_turn int, turns array<struct<{_FILE_TURN}>>"
)
SUMMARY_CSV = "query_id string, success boolean, success_turn int, total_turns int, gt_rank_improvement double, initial_rank double, final_rank double"
DETAIL_CSV = "query_id string, turn int, best_gt_rank double, query_text string, relative_caption string, selected_image string"
