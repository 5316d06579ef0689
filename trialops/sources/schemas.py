"""Columns of the recordings.  Types are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


def schema(**fields: str) -> StructType:
    kinds = {"int": IntegerType(), "double": DoubleType(), "string": StringType()}
    return StructType([StructField(name, kinds[kind]) for name, kind in fields.items()])


# Column names of the exports and the names used for them here.
ATTENTION_COLUMNS = {
    "Subject": ("subject", "int"),
    "BlockList": ("block_number", "int"),
    "Trial": ("trial", "string"),
    "Target.RT": ("rt", "int"),
    "Target.ACC": ("acc", "int"),
    "CueCond": ("cue", "string"),
    "Flanker": ("flanker", "string"),
}
STOP_COLUMNS = {
    "Subject": ("Subject", "int"),
    "Task[SubTrial]": ("Task", "string"),
    "SubTrial": ("SubTrial", "int"),
    "TrialType[SubTrial]": ("TrialType", "string"),
    "FixDuration[SubTrial]": ("FixDuration", "int"),
    "Target.RT[SubTrial]": ("Target_RT", "int"),
    "Target.ACC[SubTrial]": ("Target_ACC", "int"),
    "PreTarget.RT[SubTrial]": ("PreTarget_RT", "int"),
    "PreTarget.ACC[SubTrial]": ("PreTarget_ACC", "int"),
    "PreTarget.Duration[SubTrial]": ("PreTarget_Duration", "double"),
}
TOUCH_COLUMNS = {
    "subject_nr": ("subject", "int"),
    "trialType": ("condition", "string"),
    "response_time": ("rt", "int"),
    "correct": ("acc", "int"),
    "datetime": ("timestamp", "string"),
}
TOUCH_ANTICIPATION_COLUMNS = {**TOUCH_COLUMNS, "anticipated_count": ("anticipated_count", "int")}
GAZE_COLUMNS = {
    "TRIAL_INDEX": ("trial", "int"),
    "TRIAL_START_TIME": ("trial_start", "double"),
    "TIMESTAMP": ("timestamp", "double"),
    "LEFT_GAZE_X": ("left_x", "double"),
    "LEFT_GAZE_Y": ("left_y", "double"),
    "RIGHT_GAZE_X": ("right_x", "double"),
    "RIGHT_GAZE_Y": ("right_y", "double"),
}
GAP_OVERLAP_COLUMNS = {**GAZE_COLUMNS, "SIDE_CONDITION": ("side", "string")}
SWITCHING_COLUMNS = {
    **GAZE_COLUMNS,
    "target_side_1": ("target_side_1", "string"),
    "target_side_2": ("target_side_2", "string"),
    "ANTICIPATIONS": ("anticipations", "int"),
}
VISIT_COLUMNS = {
    "Trial": ("trial_text", "string"),
    "Stimulus": ("stimulus", "string"),
    "Participant": ("participant", "string"),
    "Eye L/R": ("eye", "string"),
    "AOI Name": ("aoi", "string"),
    "AOI Group": ("aoi_group", "string"),
    "Entry Time [ms]": ("entry_ms", "double"),
    "Sequence": ("sequence", "int"),
    "Dwell Time [ms]": ("dwell_ms", "double"),
    "Fixation Time [ms]": ("fix_ms", "double"),
}
CODED_COLUMNS = {
    "Irruption.onset": ("irruption_onset", "double"),
    "Irruption.event1": ("irruption_event1", "string"),
    "Irruption.event2": ("irruption_event2", "string"),
    "Behaviour.onset": ("behaviour_onset", "double"),
    "Behaviour.offset": ("behaviour_offset", "double"),
    "Behaviour.beh1": ("behaviour_beh1", "string"),
    "Behaviour.beh2": ("behaviour_beh2", "string"),
    "Orienting.onset": ("orienting_onset", "double"),
    "Orienting.offset": ("orienting_offset", "double"),
    "Orienting.object": ("orienting_object", "string"),
    "Toy.toy1": ("toy1", "string"),
    "Toy.toy2": ("toy2", "string"),
}

# Fixed values: (start, length) of the subject in the file name, 1-based.
GAP_OVERLAP_SUBJECT = (17, 8)
SWITCHING_SUBJECT = (13, 3)
SEQUENCE_SUBJECT = (12, 7)
