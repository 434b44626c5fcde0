"""What is known about metric types: fixed values, and the table that the operators join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.time import metric_display_name

# HealthKit's public identifiers and the groups that results depend on.
_Q = "HKQuantityTypeIdentifier"
SLEEP_METRIC, WORKOUT_METRIC = "HKCategoryTypeIdentifierSleepAnalysis", "HKWorkoutTypeIdentifier"
#: Several devices count these at once: they are stored as merged hourly totals.
MERGED_METRICS = (
    "HKQuantityTypeIdentifierStepCount", "HKQuantityTypeIdentifierDistanceWalkingRunning", "HKQuantityTypeIdentifierDistanceCycling", "HKQuantityTypeIdentifierDistanceSwimming", "HKQuantityTypeIdentifierDistanceWheelchair", "HKQuantityTypeIdentifierDistanceDownhillSnowSports", "HKQuantityTypeIdentifierPushCount",
    "HKQuantityTypeIdentifierSwimmingStrokeCount", "HKQuantityTypeIdentifierFlightsClimbed", "HKQuantityTypeIdentifierActiveEnergyBurned", "HKQuantityTypeIdentifierBasalEnergyBurned", "HKQuantityTypeIdentifierAppleExerciseTime", "HKQuantityTypeIdentifierAppleMoveTime", "HKQuantityTypeIdentifierAppleStandTime",
)
#: A day's value of these is its total.
CUMULATIVE_METRICS = ("HKQuantityTypeIdentifierStepCount", "HKQuantityTypeIdentifierActiveEnergyBurned", "HKQuantityTypeIdentifierDistanceWalkingRunning", "HKQuantityTypeIdentifierDistanceCycling", "HKQuantityTypeIdentifierBasalEnergyBurned", "HKQuantityTypeIdentifierAppleExerciseTime", "HKQuantityTypeIdentifierFlightsClimbed")
#: Everyone has these; the last two only with a wearable.
EXPECTED_METRICS = ("HKQuantityTypeIdentifierStepCount", "HKQuantityTypeIdentifierDistanceWalkingRunning", "HKQuantityTypeIdentifierHeartRate", "HKQuantityTypeIdentifierActiveEnergyBurned")
WEARABLE_METRICS = ("HKQuantityTypeIdentifierHeartRate", "HKQuantityTypeIdentifierActiveEnergyBurned")
#: Any of these proves a wearable.
EVIDENCE_METRICS = ("HKQuantityTypeIdentifierHeartRateVariabilitySDNN", "HKQuantityTypeIdentifierRestingHeartRate", "HKQuantityTypeIdentifierWalkingHeartRateAverage", "HKQuantityTypeIdentifierOxygenSaturation", "HKQuantityTypeIdentifierRespiratoryRate")
ESSENTIAL_METRICS = (
    "HKQuantityTypeIdentifierStepCount", "HKQuantityTypeIdentifierDistanceWalkingRunning", "HKQuantityTypeIdentifierActiveEnergyBurned", "HKQuantityTypeIdentifierHeartRate", "HKQuantityTypeIdentifierRestingHeartRate", "HKQuantityTypeIdentifierHeartRateVariabilitySDNN", "HKQuantityTypeIdentifierVO2Max", SLEEP_METRIC, WORKOUT_METRIC,
)
#: Records of an export that are no samples.
SKIPPED_PREFIXES = ("HKWorkoutTypeIdentifier", "HKDataTypeSleepDurationGoal", "HKClinical")
#: Names of the sleep stages, code 0 first.
STAGE_VALUES = (
    "HKCategoryValueSleepAnalysisInBed", "HKCategoryValueSleepAnalysisAsleepUnspecified", "HKCategoryValueSleepAnalysisAwake", "HKCategoryValueSleepAnalysisAsleepCore", "HKCategoryValueSleepAnalysisAsleepDeep", "HKCategoryValueSleepAnalysisAsleepREM",
)
UNKNOWN_STAGE = "HKCategoryValueSleepAnalysisUnknown"
#: Metric types by the roles that reports ask for.
ROLES = {"steps": "HKQuantityTypeIdentifierStepCount", "energy": "HKQuantityTypeIdentifierActiveEnergyBurned", "hrv": "HKQuantityTypeIdentifierHeartRateVariabilitySDNN", "rhr": "HKQuantityTypeIdentifierRestingHeartRate", "sleep": SLEEP_METRIC, "vo2": "HKQuantityTypeIdentifierVO2Max", "weight": "HKQuantityTypeIdentifierBodyMass"}

#: The unit that a metric is stored in; other metrics take the first unit of their dimension in UNITS.
PREFERRED_UNITS = {
    "count": ("StepCount", "BodyMassIndex", "FlightsClimbed", "PushCount", "UVExposure", "SwimmingStrokeCount", "NikeFuel", "InhalerUsage", "NumberOfTimesFallen"),
    "m": ("DistanceWalkingRunning", "DistanceCycling", "DistanceSwimming", "Height", "WaistCircumference", "SixMinuteWalkTestDistance", "WalkingStepLength", "DistanceDownhillSnowSports", "DistanceWheelchair", "RunningStrideLength", "UnderwaterDepth"),
    "kcal": ("ActiveEnergyBurned", "BasalEnergyBurned", "DietaryEnergyConsumed"),
    "count/min": ("HeartRate", "RestingHeartRate", "WalkingHeartRateAverage", "RespiratoryRate", "CyclingCadence"),
    "ms": ("HeartRateVariabilitySDNN", "RunningGroundContactTime"),
    "%": ("OxygenSaturation", "BodyFatPercentage", "WalkingAsymmetryPercentage", "WalkingDoubleSupportPercentage", "AppleWalkingSteadiness", "PeripheralPerfusionIndex", "BloodAlcoholContent", "AtrialFibrillationBurden"),
    "mmHg": ("BloodPressureSystolic", "BloodPressureDiastolic"),
    "kg": ("BodyMass", "LeanBodyMass"),
    "mg/dL": ("BloodGlucose",),
    "degC": ("BodyTemperature", "BasalBodyTemperature", "WaterTemperature"),
    "mL/min·kg": ("VO2Max",),
    "min": ("AppleExerciseTime", "AppleStandTime", "AppleMoveTime", "TimeInDaylight"),
    "dBASPL": ("EnvironmentalAudioExposure", "HeadphoneAudioExposure"),
    "L": ("DietaryWater", "ForcedVitalCapacity", "ForcedExpiratoryVolume1"),
    "m/s": ("WalkingSpeed", "StairAscentSpeed", "StairDescentSpeed", "CyclingSpeed", "RunningSpeed"),
    "L/min": ("PeakExpiratoryFlowRate",),
    "W": ("CyclingPower", "RunningPower", "CyclingFunctionalThresholdPower"),
    "cm": ("RunningVerticalOscillation",),
    "kcal/hr·kg": ("PhysicalEffort",),
    "g": ("DietaryFatTotal", "DietaryFatPolyunsaturated", "DietaryFatMonounsaturated", "DietaryFatSaturated", "DietaryCarbohydrates", "DietaryFiber", "DietarySugar", "DietaryProtein"),
    "mg": (
        "DietaryCaffeine", "DietaryCholesterol", "DietarySodium", "DietaryCalcium", "DietaryIron", "DietaryPotassium", "DietaryChloride", "DietaryMagnesium", "DietaryPhosphorus", "DietaryZinc", "DietaryVitaminC",
        "DietaryVitaminE", "DietaryNiacin", "DietaryPantothenicAcid", "DietaryRiboflavin", "DietaryThiamin", "DietaryVitaminB6", "DietaryCopper", "DietaryManganese",
    ),
    "mcg": ("DietaryVitaminA", "DietaryVitaminB12", "DietaryVitaminD", "DietaryVitaminK", "DietaryBiotin", "DietaryChromium", "DietaryFolate", "DietaryIodine", "DietaryMolybdenum", "DietarySelenium"),
    "IU": ("InsulinDelivery",),
    "mcS": ("ElectrodermalActivity",),
    "appleEffortScore": ("EstimatedWorkoutEffortScore",),
}
#: Dimensions and their units with factor (and offset) to the first one; metrics without a preferred unit take that one.
UNITS = {
    "count": {"count": 1.0}, "energy": {"kcal": 1.0, "Cal": 1.0, "cal": 0.001, "kJ": 1 / 4.184, "J": 1 / 4184}, "length": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "ft": 0.3048, "in": 0.0254, "yd": 0.9144},
    "mass": {"g": 1.0, "kg": 1000.0, "mg": 0.001, "mcg": 1e-6, "lb": 453.59237, "oz": 28.349523125, "st": 6350.29318}, "share": {"%": 1.0}, "time": {"s": 1.0, "ms": 0.001, "min": 60.0, "hr": 3600.0, "d": 86400.0},
    "volume": {"L": 1.0, "mL": 0.001, "fl_oz_us": 0.0295735295625}, "temperature": {"degC": 1.0, "degF": (5 / 9, -160 / 9), "K": (1.0, -273.15)}, "pressure": {"mmHg": 1.0, "kPa": 7.50061682704}, "rate": {"count/min": 1.0, "bpm": 1.0, "count/s": 60.0},
    "power": {"W": 1.0, "kW": 1000.0}, "speed": {"m/s": 1.0, "km/hr": 1 / 3.6, "mi/hr": 0.44704}, "flow": {"L/min": 1.0, "L/s": 60.0}, "glucose": {"mg/dL": 1.0}, "fitness": {"mL/min·kg": 1.0, "ml/kg·min": 1.0}, "level": {"dBASPL": 1.0},
    "effort": {"kcal/hr·kg": 1.0}, "dose": {"IU": 1.0}, "conductance": {"mcS": 1.0, "S": 1e6}, "score": {"appleEffortScore": 1.0},
}
#: Names of workout activities by code, as published; codes 15 and 74 have no name here, and above 80 the codes are not consecutive.
ACTIVITIES = dict(enumerate((
    "AmericanFootball", "Archery", "AustralianFootball", "Badminton", "Baseball", "Basketball", "Bowling", "Boxing", "Climbing", "Cricket", "CrossTraining", "Curling", "Cycling", "Dance", None, "Elliptical", "EquestrianSports", "Fencing", "Fishing",
    "FunctionalStrengthTraining", "Golf", "Gymnastics", "Handball", "Hiking", "Hockey", "Hunting", "Lacrosse", "MartialArts", "MindAndBody", "MixedMetabolicCardioTraining", "PaddleSports", "Play", "PreparationAndRecovery", "Racquetball", "Rowing", "Rugby",
    "Running", "Sailing", "SkatingSports", "SnowSports", "Soccer", "Softball", "Squash", "StairClimbing", "SurfingSports", "Swimming", "TableTennis", "Tennis", "TrackAndField", "TraditionalStrengthTraining", "Volleyball", "Walking", "WaterFitness",
    "WaterPolo", "WaterSports", "Wrestling", "Yoga", "Barre", "CoreTraining", "CrossCountrySkiing", "DownhillSkiing", "Flexibility", "HighIntensityIntervalTraining", "JumpRope", "Kickboxing", "Pilates", "Snowboarding", "Stairs", "StepTraining",
    "WheelchairWalkPace", "WheelchairRunPace", "TaiChi", "MixedCardio", None, "DiscSports", "FitnessGaming", "CardioDance", "SocialDance", "Pickleball", "Cooldown",
), 1)) | {82: "SwimBikeRun", 83: "Transition", 84: "UnderwaterDiving", 3000: "Other"}


def activity_name(code: Column) -> Column:
    """Full name of a workout activity's code, Unknown for codes without one."""
    names = F.create_map(*[F.lit(x) for c, n in ACTIVITIES.items() if n for x in (c, n)])
    return F.concat(F.lit("HKWorkoutActivityType"), F.coalesce(names[code.cast("int")], F.lit("Unknown")))


def unit_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """PREFERRED_UNITS as (metric_type, preferred) and UNITS as (unit, dimension, factor, offset, fallback)."""
    preferred = [(_Q + m, u) for u, ms in PREFERRED_UNITS.items() for m in ms]
    pair = lambda f: f if isinstance(f, tuple) else (f, 0.0)
    units = [(u, d, *pair(f), next(iter(us))) for d, us in UNITS.items() for u, f in us.items()]
    return spark.createDataFrame(preferred, "metric_type string, preferred string"), spark.createDataFrame(units, "unit string, dimension string, factor double, offset double, fallback string")


def metric_catalog(spark: SparkSession) -> DataFrame:
    """metric_type, display_name and the groups it is in, one row per metric of any group."""
    groups = {"cumulative": CUMULATIVE_METRICS, "merged": MERGED_METRICS, "always_expected": EXPECTED_METRICS, "wearable": WEARABLE_METRICS, "evidence": EVIDENCE_METRICS, "is_essential": ESSENTIAL_METRICS}
    every = sorted({m for g in groups.values() for m in g} | set(ROLES.values()))
    rows = [(m, *(m in g for g in groups.values())) for m in every]
    df = spark.createDataFrame(rows, "metric_type string, " + ", ".join(f"{g} boolean" for g in groups))
    return df.select("metric_type", metric_display_name(F.col("metric_type")).alias("display_name"), *groups)
