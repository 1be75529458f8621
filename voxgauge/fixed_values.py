"""Thresholds, label sets, patterns and formats that results depend on.

These are facts of the evaluation protocol, not choices of this engine; changing one changes published results.
"""

# --- thresholds ---------------------------------------------------------------------------------------------
CONTENT_ERROR_MAX = {"en": 0.10, "zh": 0.10}
SPEAKER_TARGET_MIN = 0.50
SPEAKER_PRESERVATION_MIN = 0.75
SPEED_CHANGE_MIN = 0.05
PITCH_SHIFT_MIN_SEMITONES = 0.3
PROMINENCE_GAIN_MIN = 0.0
PROMINENCE_EPS = 1e-8
PROMINENCE_MIN_WINDOW_SECONDS = 0.02
PROMINENCE_WEIGHTS = {"energy": 0.5, "f0": 0.3, "duration": 0.2}
PERCEPTUAL_OVRL_GAIN = 0.0
PERCEPTUAL_BAK_GAIN = 0.0
SCENE_SCORE_MIN = 0.1
SCENE_GAIN_MIN = 0.03
DECAY_TOLERANCE_LOW = 0.8
DECAY_TOLERANCE_HIGH = 1.2
DECAY_FLOOR_SECONDS = 0.03
DECAY_ERRORS = {"short": "impulse response too short for RT60 estimate", "silent": "silent impulse response"}
UNCHANGED_MEAN_SQUARE = 1e-8
DECAY_CEILING_SECONDS = 4.0
STYLE_SCORE_MIN = 3
STYLE_SCORE_MAX = 4
EVENT_PRESENT_MIN = 2
EVENT_ABSENT_MAX = 1
EVENT_SCORE_MAX = 3

# --- signal geometry ----------------------------------------------------------------------------------------
FRAME_LENGTH = 1024
FRAME_HOP = 256
SAMPLE_RATE = 16000
SEGMENT_SECONDS = 9.01
SHORT_CLIP_SECONDS = (0.8, 1.0, 1.5, 2.0, 3.0)

# --- perceptual score calibration: highest power first --------------------------------------------------------
CALIBRATION = {
    "sig": (-0.08397278, 1.22083953, 0.0052439),
    "bak": (-0.13166888, 1.60915514, -0.39604546),
    "ovr": (-0.06766283, 1.11546468, 0.04602535),
}

# --- files --------------------------------------------------------------------------------------------------
OUTPUT_EXTENSIONS = ("wav", "flac", "mp3")  # in order of preference
ASSET_SUFFIXES = ("flac", "mp3", "ogg", "wav")
DECLARED_SUFFIXES = ("wav", "flac", "mp3", "ogg", "m4a", "aac")
DECLARED_PREFIX = "data/"
FALLBACK_ALLOW_PATTERN = "data/**"
DATASET_VERSION = "v1.1"

# --- tasks --------------------------------------------------------------------------------------------------
TASKS = (
    "acoustic_editing",
    "content_editing",
    "compositional_editing",
    "emotion_editing",
    "paralinguistic_editing",
    "prosody_editing",
    "speaker_editing",
    "style_editing",
)
FATAL_STATUSES = ("preflight_error", "not_implemented", "error")

# --- scorer groups ------------------------------------------------------------------------------------------
GROUP_ASR_EN = "asr_en_whisper"
GROUP_ASR_ZH = "asr_zh_paraformer"
GROUP_TIMESTAMP_ZH = "asr_zh_timestamp"
GROUP_SPEAKER = "speaker_wavlm"
GROUP_JUDGE = "gemini"
GROUP_PERCEPTUAL = "dnsmos"
GROUP_SCENE = "panns"
TASK_DEFAULT_GROUPS = {
    "content_editing": ("asr_en_whisper", "asr_zh_paraformer"),
    "speaker_editing": ("speaker_wavlm", "asr_en_whisper", "asr_zh_paraformer"),
    "emotion_editing": ("gemini", "asr_en_whisper", "asr_zh_paraformer"),
    "style_editing": ("gemini", "asr_en_whisper", "asr_zh_paraformer"),
    "paralinguistic_editing": ("gemini", "asr_en_whisper", "asr_zh_paraformer"),
    "prosody_editing": ("asr_en_whisper", "asr_zh_paraformer", "asr_zh_timestamp"),
    "acoustic_editing": ("asr_en_whisper", "asr_zh_paraformer", "dnsmos", "panns"),
    "compositional_editing": (
        "gemini", "speaker_wavlm", "asr_en_whisper", "asr_zh_paraformer",
        "asr_zh_timestamp", "dnsmos", "panns",
    ),
}

# --- labels -------------------------------------------------------------------------------------------------
STYLES = ("public-broadcast", "intimate", "dramatic", "restrained-flat", "storytelling", "conversational")
EVENTS = ("breath", "laugh", "cough", "sigh")
EMOTIONS_BY_TAXONOMY = {
    "iemocap_en": ("angry", "excited", "fearful", "frustrated", "happy", "neutral", "sad", "surprise"),
    "csemotions_zh": ("angry", "fearful", "happy", "neutral", "playfulness", "sad", "surprise"),
}
TAXONOMY_BY_DATASET = {
    "iemocap": "iemocap_en",
    "libritts_test_clean": "iemocap_en",
    "csemotions": "csemotions_zh",
    "aishell3_test": "csemotions_zh",
}
EMOTION_ALIASES = {
    "fear": "fearful",
    "fearful": "fearful",
    "surprised": "surprise",
    "playful": "playfulness",
    "playfulness": "playfulness",
    "frustration": "frustrated",
    "neutral": "neutral",
    "angry": "angry",
    "happy": "happy",
    "sad": "sad",
    "excited": "excited",
    "frustrated": "frustrated",
    "surprise": "surprise",
}
SCENE_LABELS = {
    "outdoor": (
        "Outside, urban or manmade",
        "Outside, rural or natural",
        "Traffic noise, roadway noise",
        "Vehicle",
        "Motor vehicle (road)",
        "Wind",
        "Rain",
        "Bird",
        "Water",
    ),
    "crowd": (
        "Crowd",
        "Hubbub, speech noise, speech babble",
        "Cheering",
        "Applause",
        "Children shouting",
    ),
    "music": (
        "Music",
        "Background music",
        "Musical instrument",
        "Singing",
        "Pop music",
        "Electronic music",
    ),
}
TRUTHY_WORDS = ("true", "yes", "y", "1", "success", "successful")

# --- audit --------------------------------------------------------------------------------------------------
AUDIT_LABEL_KEYS = (
    "source_emotion", "target_emotion", "source_style", "target_style",
    "operation", "event", "prosody_type", "direction", "subtask",
    "env_type", "env_subtype", "degradation_type", "edit_type",
)
AUDIT_PATTERNS = {
    "position_or_scope": (
        r"\b(after|before|between|pause|pauses|boundary|boundaries|throughout|"
        r"at the beginning|at the end|natural pauses|position|word|phrase)\b|"
        r"在|之前|之后|开头|结尾|停顿|位置|全程|贯穿"
    ),
    "intensity_or_extra_manner": (
        r"\b(intense|strong|subtle|slightly|clearly|heightened|overwhelming|"
        r"warm|authoritative|dramatic|casual|urgent|nervous|unease|dread)\b|"
        r"紧张|颤抖|强烈|轻微|明显|急促|压抑|氛围|温暖|权威|自然"
    ),
    "content_preservation_text": (
        r"保留|保持|content unchanged|content and speaking style remain unchanged|"
        r"preserve|语义|内容"
    ),
    "meta_instruction": r"语音编辑系统|speech editing system|重录|重新录制|请你|you need to",
}
TEMPLATE_LABEL_WORDS = (
    r"\b(angry|happy|sad|neutral|fear|fearful|surprise|playfulness|"
    r"excited|frustrated|dramatic|storytelling|conversational|intimate|"
    r"public[- ]broadcast|restrained[- ]flat|breath|laugh|cough|sigh)\b"
)
TEMPLATE_QUOTE_MARK = '"<q>"'
TEMPLATE_LABEL_MARK = "<label>"
TOP_TEMPLATES = 8
TOP_ERRORS = 3
TOP_SCENE_LABELS = 5
MISSING_PATHS_SHOWN = 20
MISSING_GROUPS_SHOWN = 4
