"""Fixed physical and model-time values used by the analysis formulas."""

# They must equal the published analysis for results to agree.
GRAVITY = 9.8
EXPANSION = 2e-4
PE_COEFFICIENT = 4e-4
PE_TENDENCY_SCALE = 9.8 / 4.0
TENDENCY_SECONDS = 3600.0
SURFACE_TEMPERATURE = 28.0
TIDE_SECONDS = 44640.0
TIDE_HOURS = 12.4
FORCING_STEP_SECONDS = 1240.0
FORCING_SAMPLES = 36
SNAPSHOT_SECONDS = 1860.0
DISSIPATION_PHASE_SECONDS = 930.0
PROFILE_DZ = 10.0
DIFFUSIVITY_FLOOR = 1e-5
