"""Wire codes and documented ranges (fixed values), and decoding by them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and names as they are on the wire.
IMAGE_TYPE = {0: "TYPE_NONE", 1: "ROLL_SINGLE_FINGER", 2: "FLAT_SINGLE_FINGER", 3: "FLAT_TWO_FINGERS", 4: "FLAT_FOUR_FINGERS", 5: "FLAT_THREE_FINGERS"}
IMAGE_FORMAT = {0: "GRAY", 1: "RGB24", 2: "RGB32", 3: "UNKNOWN"}
RESOLUTION = {500: "RESOLUTION_500", 1000: "RESOLUTION_1000"}
FINGER_COUNT = {0: "FINGER_COUNT_OK", 1: "TOO_MANY_FINGERS", 2: "TOO_FEW_FINGERS", 3: "NON_FINGER"}
FINGER_QUALITY = {0: "FINGER_NOT_PRESENT", 1: "GOOD", 2: "FAIR", 3: "POOR", 4: "INVALID_AREA_TOP", 5: "INVALID_AREA_LEFT", 6: "INVALID_AREA_RIGHT", 7: "INVALID_AREA_BOTTOM"}
PLATEN = {0: "CLEARD", 1: "HAS_FINGERS"}
ROLLING = {0: "NOT_PRESENT", 1: "TAKE_ACQUISITION", 2: "COMPLETE_ACQUISITION", 3: "RESULT_IMAGE"}
EVENT_TYPE = {
    1: "COMMUNICATION_BROKEN", 2: "PREVIEW_IMAGE_AVAILABLE", 3: "ACQUISITION_BEGUN", 4: "ACQUISITION_COMPLETED", 5: "RESULT_IMAGE_AVAILABLE", 6: "FINGER_QUALITY_CHANGED",
    7: "FINGER_COUNT_CHANGED", 9: "PLATEN_STATE_CHANGED", 11: "WARNING_RECEIVED", 12: "RESULT_IMAGE_EXTENDED_AVAILABLE", 13: "KEYBUTTON"}
STORED_FORMAT = {0: "NO_BIT_PACKING", 1: "BIT_PACKED", 2: "WSQ", 3: "JPEG_LOSSY", 4: "JPEG2000_LOSSY", 5: "JPEG2000_LOSSLESS", 6: "PNG"}
IMPRESSION_TYPE = {
    0: "LIVE_SCAN_PLAIN", 1: "LIVE_SCAN_ROLLED", 2: "NONLIVE_SCAN_PLAIN", 3: "NONLIVE_SCAN_ROLLED", 4: "LATENT_IMPRESSION", 5: "LATENT_TRACING", 6: "LATENT_PHOTO", 7: "LATENT_LIFT",
    8: "LIVE_SCAN_SWIPE", 9: "LIVE_SCAN_VERTICAL_ROLL", 10: "LIVE_SCAN_PALM", 11: "NONLIVE_SCAN_PALM", 12: "LATENT_PALM_IMPRESSION", 13: "LATENT_PALM_TRACING", 14: "LATENT_PALM_PHOTO",
    15: "LATENT_PALM_LIFT", 24: "LIVE_SCAN_OPTICAL_CONTRCTLESS_PLAIN", 28: "OTHER", 29: "UNKNOWN"}
FINGER_POSITION = {
    0: "UNKNOWN", 1: "RIGHT_THUMB", 2: "RIGHT_INDEX_FINGER", 3: "RIGHT_MIDDLE_FINGER", 4: "RIGHT_RING_FINGER", 5: "RIGHT_LITTLE_FINGER", 6: "LEFT_THUMB", 7: "LEFT_INDEX_FINGER",
    8: "LEFT_MIDDLE_FINGER", 9: "LEFT_RING_FINGER", 10: "LEFT_LITTLE_FINGER", 13: "PLAIN_RIGHT_FOUR_FINGERS", 14: "PLAIN_LEFT_FOUR_FINGERS", 15: "PLAIN_THUMBS", 20: "UNKNOWN_PALM",
    21: "RIGHT_FULL_PALM", 22: "RIGHT_WRITERS_PALM", 23: "LEFT_FULL_PALM", 24: "LEFT_WRITERS_PALM", 25: "RIGHT_LOWER_PALM", 26: "RIGHT_UPPER_PALM", 27: "LEFT_LOWER_PALM",
    28: "LEFT_UPPER_PALM", 29: "RIGHT_OTHER", 30: "LEFT_OTHER", 31: "RIGHT_INTERDIGITAL", 32: "RIGHT_THENAR", 33: "RIGHT_HYPOTHENAR", 34: "LEFT_INTERDIGITAL", 35: "LEFT_THENAR",
    36: "LEFT_HYPOTHENAR", 40: "RIGHT_INDEX_AND_MIDDLE", 41: "RIGHT_MIDDLE_AND_RING", 42: "RIGHT_RING_AND_LITTLE", 43: "LEFT_INDEX_AND_MIDDLE", 44: "LEFT_MIDDLE_AND_RING",
    45: "LEFT_RING_AND_LITTLE", 46: "RIGHT_INDEX_AND_LEFT_INDEX", 47: "RIGHT_INDEX_AND_MIDDLE_AND_RING", 48: "RIGHT_MIDDLE_AND_RING_AND_LITTLE", 49: "LEFT_INDEX_AND_MIDDLE_AND_RING",
    50: "LEFT_MIDDLE_AND_RING_AND_LITTLE"}
CAPTURE_TECH = {
    0: "UNKNOWN_OR_UNSPECIFIED", 1: "WHITE_LIGHT_OPTICAL_TIR", 2: "WHITE_LIGHT_OPTICAL_DIRECT_VIEW_ON_PLATEN", 3: "WHITE_LIGHT_OPTICAL_TOUCHLESS", 4: "MONOCHROMATIC_VISIBLE_OPTICAL_TIR",
    5: "MONOCHROMATIC_VISIBLE_OPTICAL_DIRECT_VIEW_ON_PLATEN", 6: "MONOCHROMATIC_VISIBLE_OPTICAL_TOUCHLESS", 7: "MONOCHROMATIC_IR_OPTICAL_TIR",
    8: "MONOCHROMATIC_IR_OPTICAL_DIRECT_VIEW_ON_PLATEN", 9: "MONOCHROMATIC_IR_OPTICAL_TOUCHLESS", 10: "MULTISPECTRAL_OPTICAL_TIR", 11: "MULTISPECTRAL_OPTICAL_DIRECT_VIEW_ON_PLATEN",
    12: "MULTISPECTRAL_OPTICAL_TOUCHLESS", 13: "ELECTRO_LUMINESCENT", 14: "SEMICONDUCTOR_CAPACITIVE", 15: "SEMICONDUCTOR_RF", 16: "SEMICONDUCTOR_THEMAL", 17: "PRESSURE_SENSITIVE",
    18: "ULTRASOUND", 19: "MECHANICAL", 20: "GLASS_FIBER"}
FINGER_BITS = {1: "LEFT_LITTLE", 2: "LEFT_RING", 4: "LEFT_MIDDLE", 8: "LEFT_INDEX", 16: "LEFT_THUMB", 32: "RIGHT_THUMB", 64: "RIGHT_INDEX", 128: "RIGHT_MIDDLE", 256: "RIGHT_RING", 512: "RIGHT_LITTLE"}
#: Groups of fingers: bits of which one is set at least (hands and thumbs), and pairs, of which both are.
HANDS = {"left_hand": 15, "right_hand": 960, "thumbs": 48}
PAIRS = {"left_little_ring": 3, "left_middle_index": 12, "right_index_middle": 192, "right_ring_little": 768}
OPTIONS = {1: "AUTO_CONTRAST", 2: "AUTO_CAPTURE", 4: "IGNORE_FINGER_COUNT"}
COMMAND_FAILED = -10
#: Names of the status codes.
STATUS_NAMES = {
    0: "STATUS_OK",
    -1: "INVALID_PARAM_VALUE", -2: "MEM_ALLOC", -3: "NOT_SUPPORTED", -4: "FILE_OPEN", -5: "FILE_READ", -6: "RESOURCE_LOCKED", -7: "MISSING_RESOURCE", -8: "INVALID_ACCESS_POINTER",
    -9: "THREAD_CREATE", -10: "COMMAND_FAILED", -11: "LIBRARY_UNLOAD_FAILED", -100: "CHANNEL_IO_COMMAND_FAILED", -101: "CHANNEL_IO_READ_FAILED", -102: "CHANNEL_IO_WRITE_FAILED",
    -103: "CHANNEL_IO_READ_TIMEOUT", -104: "CHANNEL_IO_WRITE_TIMEOUT", -105: "CHANNEL_IO_UNEXPECTED_FAILED", -106: "CHANNEL_IO_INVALID_HANDLE", -107: "CHANNEL_IO_WRONG_PIPE_INDEX",
    -200: "DEVICE_IO", -201: "DEVICE_NOT_FOUND", -202: "DEVICE_NOT_MATCHED", -203: "DEVICE_ACTIVE", -204: "DEVICE_NOT_INITIALIZED", -205: "DEVICE_INVALID_STATE", -206: "DEVICE_BUSY",
    -207: "DEVICE_NOT_SUPPORTED_FEATURE", -208: "INVALID_LICENSE", -209: "USB20_REQUIRED", -210: "DEVICE_ENABLED_POWER_SAVE_MODE", -211: "DEVICE_NEED_UPDATE_FIRMWARE",
    -212: "DEVICE_NEED_CALIBRATE_TOF", -213: "DEVICE_INVALID_CALIBRATION_DATA", -299: "DEVICE_NOT_ACCESSIBLE", -300: "CAPTURE_COMMAND_FAILED", -301: "CAPTURE_STOP", -302: "CAPTURE_TIMEOUT",
    -303: "CAPTURE_STILL_RUNNING", -304: "CAPTURE_NOT_RUNNING", -305: "CAPTURE_INVALID_MODE", -306: "CAPTURE_ALGORITHM", -307: "CAPTURE_ROLLING", -308: "CAPTURE_ROLLING_TIMEOUT",
    -500: "NBIS_NFIQ_FAILED", -501: "NBIS_WSQ_ENCODE_FAILED", -502: "NBIS_WSQ_DECODE_FAILED", -600: "DUPLICATE_EXTRACTION_FAILED", -601: "DUPLICATE_ALREADY_USED",
    -602: "DUPLICATE_SEGMENTATION_FAILED", -603: "DUPLICATE_MATCHING_FAILED", 100: "CHANNEL_IO_FRAME_MISSING", 101: "CHANNEL_IO_CAMERA_WRONG", 102: "CHANNEL_IO_SLEEP_STATUS",
    200: "OUTDATED_FIRMWARE", 201: "ALREADY_INITIALIZED", 202: "API_DEPRECATED", 203: "ALREADY_ENHANCED_IMAGE", 300: "BGET_IMAGE", 301: "ROLLING_NOT_RUNNING", 302: "NO_FINGER",
    303: "INCORRECT_FINGERS", 304: "ROLLING_SMEAR", 305: "ROLLING_SHIFTED_HORIZONTALLY", 306: "ROLLING_SHIFTED_VERTICALLY", 307: "ROLLING_SHIFTED_HORIZONTALLY_VERTICALLY",
    400: "EMPTY_IBSM_RESULT_IMAGE", 512: "QUALITY_INVALID_AREA", 513: "QUALITY_INVALID_AREA_HORIZONTALLY", 514: "QUALITY_INVALID_AREA_VERTICALLY",
    515: "QUALITY_INVALID_AREA_HORIZONTALLY_VERTICALLY", 600: "INVALID_BRIGHTNESS_FINGERS", 601: "WET_FINGERS", 602: "MULTIPLE_FINGERS_DURING_ROLL"}
#: Families of status codes, as inclusive ranges.
FAMILIES = [(-11, -1, "general"), (-199, -100, "channel"), (-299, -200, "device"), (-399, -300, "capture"), (-499, -400, "client"), (-599, -500, "codec"), (-699, -600, "duplicate"), (100, 199, "trace"), (200, 299, "api"), (300, 399, "acquisition"), (400, 499, "image"), (512, 515, "area"), (600, 699, "finger")]
#: property: least, most (CAPTURE_TIMEOUT may also be -1).
PROPERTY_RANGES = {"IGNORE_FINGER_TIME": (2000, 10000), "RETRY_WRONG_COMMUNICATION": (1, 120), "CAPTURE_TIMEOUT": (10, 3600), "ROLL_MIN_WIDTH": (10, 30), "ROLL_MODE": (0, 1), "ROLL_LEVEL": (0, 2), "CAPTURE_AREA_THRESHOLD": (0, 12), "MIN_CAPTURE_TIME_IN_SUPER_DRY_MODE": (600, 3000), "WET_FINGER_DETECT_LEVEL": (1, 5), "START_POSITION_OF_ROLLING_AREA": (0, 9), "RESERVED_IMAGE_PROCESS_THRESHOLD": (0, 2)}
PROPERTY_EXTRA = {"CAPTURE_TIMEOUT": (-1,)}
#: property: least, most and number of the values, separated by spaces.
PROPERTY_LISTS = {"WET_FINGER_DETECT_LEVEL_THRESHOLD": (10, 1000, 5)}


def lookup(code: Column, table: dict) -> Column:
    """The table's value for a code, null for an unknown one: a literal map, so no join."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), code)
