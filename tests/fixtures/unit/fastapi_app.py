from fastapi import FastAPI
from fastapi.responses import JSONResponse
from pydantic import BaseModel

app = FastAPI()


class SignupIn(BaseModel):
    handle: str
    mail: str
    years: int
    model_config = {}


class ProfileIn(BaseModel):
    profileId: int
    label: str


@app.get('/api/ping')
def ping():
    return JSONResponse(content={"alive": True, "build": "1.0"})


@app.post('/api/signup')
def signup(data: SignupIn):
    return {"ok": True}


@app.post('/api/profile')
def profile(item: ProfileIn):
    print(item.label)
    return {"saved": True}
